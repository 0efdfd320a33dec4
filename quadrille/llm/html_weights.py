"""Weights of html_extract, written by html_training."""

WEIGHTS: dict[str, float] = {
    "article:1": -0.9216,
    "article:2": -0.0512,
    "article:3": -0.0211,
    "article:4": -0.1128,
    "article:5": -0.3604,
    "aside:1": -0.0058,
    "aside:2": -0.0165,
    "aside:3": -0.0182,
    "aside:4": -0.0936,
    "aside:5": -0.1033,
    "cell:1": 0.9956,
    "cell:2": 0.9639,
    "copyright": -2.2524,
    "dialog:2": -0.0153,
    "dialog:3": -0.0842,
    "dialog:4": -0.206,
    "dialog:5": -0.0176,
    "div:1": -1.8001,
    "div:2": -1.1372,
    "div:3": -0.3241,
    "div:4": -0.2702,
    "div:5": 0.1334,
    "figure:1": 0.0162,
    "figure:2": 0.0697,
    "figure:3": 0.1365,
    "footer:1": -0.0082,
    "footer:2": -0.0575,
    "footer:3": -0.1255,
    "footer:4": -0.2211,
    "footer:5": -0.0303,
    "form:1": -1.2802,
    "form:2": -1.181,
    "h1:1": -1.8513,
    "h1:2": -0.2591,
    "h1:3": 2.2961,
    "h1:4": 0.4914,
    "header:1": -0.3349,
    "header:2": -0.1768,
    "heading:1": -0.5912,
    "heading:2": -0.2037,
    "heading:3": 0.5353,
    "in:article": -1.5654,
    "in:aside": -0.7853,
    "in:cell": 1.4151,
    "in:dialog": -0.3175,
    "in:div": -0.9716,
    "in:figure": 0.574,
    "in:footer": -1.0365,
    "in:form": -1.7112,
    "in:h1": 0.9882,
    "in:header": -0.5172,
    "in:heading": -0.2855,
    "in:item": -0.6586,
    "in:p": 0.1681,
    "in:section": -1.1225,
    "item:1": -1.851,
    "item:2": -0.495,
    "item:3": 2.4743,
    "item:4": 2.3941,
    "item:5": -0.3902,
    "links:0": 0.5154,
    "links:2": -0.2063,
    "links:3": -1.4983,
    "p:1": 1.7858,
    "p:2": 0.0215,
    "p:3": -0.9765,
    "p:4": -1.1117,
    "p:5": -0.5052,
    "plain:00": 2.8746,
    "plain:01": -3.1675,
    "plain:10": -2.8326,
    "plain:11": 3.0119,
    "region:00": 1.6489,
    "region:01": -2.1434,
    "region:10": 1.7751,
    "region:11": -2.1049,
    "says:ad": -2.0698,
    "says:comment": -2.2525,
    "says:content": 2.0959,
    "says:footer": -1.3407,
    "says:form": -0.9744,
    "says:header": -1.6514,
    "says:menu": -1.1175,
    "says:notice": -1.9436,
    "says:share": -0.8001,
    "says:side": -1.7116,
    "section:1": 0.0011,
    "section:2": -0.0184,
    "section:3": -0.0459,
    "section:4": -0.1921,
    "section:5": -0.1953,
    "sentence": 0.4165,
    "tag:article": -0.5513,
    "tag:aside": -1.9682,
    "tag:cell": 1.433,
    "tag:dialog": -0.6561,
    "tag:div": -0.8148,
    "tag:figure": 1.0869,
    "tag:footer": -1.6395,
    "tag:form": -1.5759,
    "tag:h1": 1.9298,
    "tag:header": 1.8476,
    "tag:heading": 0.2113,
    "tag:item": -0.5579,
    "tag:list": -0.0771,
    "tag:main": 0.8734,
    "tag:nav": -0.6676,
    "tag:p": 0.1604,
    "tag:quote": 1.3393,
    "tag:root": 3.1709,
    "tag:section": -0.3393,
    "tag:table": 1.3256,
    "text:00": 2.9622,
    "text:01": -2.9337,
    "text:10": -3.0509,
    "text:11": 2.8803,
    "top:article": 2.1003,
    "top:main": 0.8734,
}
