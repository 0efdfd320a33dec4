"""Named spatial indexes: clustered, cached and persistable DataFrames."""
