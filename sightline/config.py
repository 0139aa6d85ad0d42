"""Settings, and the fixed values that comparison results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

# Names, lists, orders and numbers as results need them.

ANCHOR_ATTRIBUTES = "data-testid data-test data-qa data-cy data-automation-id data-key data-record-id data-component-id data-row-key-value".split()

IRRELEVANT_TAGS = "script style meta link noscript br hr head title base template slot wbr param track source area col colgroup".split()

CSS_PROPERTIES = """
font-family font-size font-weight font-style line-height letter-spacing word-spacing text-align text-decoration text-transform
color background-color opacity visibility padding padding-top padding-right padding-bottom padding-left
margin margin-top margin-right margin-bottom margin-left gap
display position float clear overflow overflow-x overflow-y
width height max-width max-height min-width min-height top right bottom left z-index
flex-direction flex-wrap flex-grow flex-shrink flex-basis justify-content align-items align-content align-self
grid-template-columns grid-template-rows grid-column grid-row
border border-width border-style border-color
border-top-width border-right-width border-bottom-width border-left-width
border-top-style border-right-style border-bottom-style border-left-style
border-top-color border-right-color border-bottom-color border-left-color
border-radius border-top-left-radius border-top-right-radius border-bottom-right-radius border-bottom-left-radius
box-shadow text-shadow
""".split()

DYNAMIC_PROPERTIES = """
font-family font-size font-weight font-style line-height letter-spacing text-align text-decoration text-transform
color background-color opacity visibility display position float
width height max-width max-height min-width min-height top right bottom left z-index
padding padding-top padding-right padding-bottom padding-left margin margin-top margin-right margin-bottom margin-left gap
flex-direction flex-wrap flex-grow flex-shrink flex-basis justify-content align-items align-self
grid-template-columns grid-template-rows border-width border-style border-color border-radius box-shadow
""".split()

DYNAMIC_ATTRIBUTES = "role aria-label aria-labelledby aria-describedby type name data-testid data-test data-qa data-cy".split()

SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_PROPERTIES = {
    "critical": "display visibility position z-index".split(),
    "high": "width height max-width max-height min-width min-height color background-color opacity font-size font-family font-weight".split(),
    "medium": """
        margin-top margin-right margin-bottom margin-left padding-top padding-right padding-bottom padding-left
        border-top-width border-bottom-width border-left-width border-right-width
        border-top-color border-bottom-color border-left-color border-right-color line-height text-align font-style
    """.split(),
}

PROPERTY_CATEGORIES = {
    "layout": "display position float clear width height min-width max-width min-height max-height".split(),
    "visual": "color background-color border-top-color border-right-color border-bottom-color border-left-color opacity visibility box-shadow text-shadow".split(),
    "typography": "font-family font-size font-weight font-style line-height text-align text-decoration letter-spacing word-spacing".split(),
    "spacing": "margin-top margin-right margin-bottom margin-left padding-top padding-right padding-bottom padding-left".split(),
    "position": "top right bottom left z-index".split(),
}

INHERITABLE = """
color visibility font-size font-weight font-style font-family font-variant font-stretch line-height letter-spacing word-spacing
text-align text-indent text-transform text-decoration white-space word-break overflow-wrap direction
list-style-type list-style-position border-collapse border-spacing caption-side quotes tab-size orphans widows
""".split()
BORDER_COLORS = "border-top-color border-right-color border-bottom-color border-left-color".split()
APEX_INHERITABLE = "color font-family font-size font-weight font-style line-height letter-spacing text-align word-spacing visibility text-transform white-space".split()
APEX_LAYOUT = "width height margin-top margin-right margin-bottom margin-left padding-top padding-right padding-bottom padding-left".split()
APEX_TOLERANCE_PX = 2

SEVERITY_WEIGHTS = {"critical": 10.0, "high": 4.0, "medium": 1.5, "low": 0.3}
MAX_PENALTY = 100.0
TEXT_RATIO_CAP = 4.0
TEXT_COMPARED = 500
MAX_ELEMENTS = 10_000

COLOR_PROPERTIES = "color background-color border-color border-top-color border-right-color border-bottom-color border-left-color outline-color text-decoration-color column-rule-color caret-color".split()
SIZE_PROPERTIES = """
width height min-width max-width min-height max-height top right bottom left
margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left
border-width border-top-width border-right-width border-bottom-width border-left-width
border-radius border-top-left-radius border-top-right-radius border-bottom-right-radius border-bottom-left-radius
font-size line-height letter-spacing word-spacing gap row-gap column-gap grid-gap outline-width outline-offset text-indent
""".split()
FOUR_SIDES = {
    "margin": "margin-top margin-right margin-bottom margin-left".split(),
    "padding": "padding-top padding-right padding-bottom padding-left".split(),
    "border-width": "border-top-width border-right-width border-bottom-width border-left-width".split(),
    "border-style": "border-top-style border-right-style border-bottom-style border-left-style".split(),
    "border-color": BORDER_COLORS,
    "border-radius": "border-top-left-radius border-top-right-radius border-bottom-right-radius border-bottom-left-radius".split(),
}
SHORTHANDS = "margin padding border-width border-style border-color border-radius border border-top border-right border-bottom border-left background font".split()
BORDER_STYLES = "none hidden dotted dashed solid double groove ridge inset outset".split()

CSS_KEYWORDS = "auto none initial inherit unset normal".split()
COLOR_KEYWORDS = "currentcolor inherit initial unset revert".split()
UNIT_FACTORS = {"px": 1.0, "em": 16.0, "rem": 16.0, "vw": 10.24, "vh": 7.68, "vmin": 7.68, "vmax": 10.24, "pt": 1.333333, "pc": 16.0, "in": 96.0, "cm": 37.7952755906, "mm": 3.77952755906, "q": 0.94488188976}
GENERIC_FONTS = "serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace ui-rounded".split()
FONT_ALIASES = {"comic sans ms": "Comic Sans MS", "trebuchet ms": "Trebuchet MS"}  # the other known fonts are their words capitalised

FRAMEWORK_ATTRIBUTES = [r"^ng-", r"^_ngcontent", r"^_nghost", r"^v-", r"^data-v-[a-f0-9]+$", r"^jsx-", r"^data-reactid", r"^data-react-"]
DYNAMIC_IDS = [r"^\d+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^\d{13,}$", r"^[a-f0-9]{32,}$", r"^(ember|react|vue|angular)\d+$", r"^uid-\d+$", r"^temp[-_]?\d+$", r"-\d{2,}$"]
DYNAMIC_CLASSES = [r"^Mui[A-Z]\w+-\w+-\d+$", r"^makeStyles-", r"^css-[a-z0-9]+$", r"^jss\d+$", r"^sc-[a-z]+-[a-z]+$", r"^emotion-\d+$", r"^lwc-[a-z0-9]+"]
TRACKING_PARAMS = r"(?i)^(utm_.*|gclid|gad_source|fbclid|msclkid|_ga|_gl)$"

UNSTABLE_VALUES = [r"^[0-9]{8,}$", r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}", r"(?i)data-aura-rendered", r"(?i)^ember\d+$", r"(?i)^react\d+$", r"^\d{13}$", r"^tt-for-\d+$", r"(?i)^[0-9]+:[0-9]+;[a-z]$", r"-\d+-\d+$"]
DYNAMIC_TEXTS = [r"^\d+$", r"^[0-9]{8,}$", r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}", r"^\d{1,2}:\d{2}", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"(?i)^loading", r"(?i)^processing", r"^\$\d+\.\d{2}$"]
SELECTOR_TEST_ATTRIBUTES = "data-testid data-test data-qa data-cy data-automation-id".split()
SEMANTIC_ATTRIBUTES = "placeholder alt title name value for".split()
STAGE_HOSTS = r"\b(stage|staging|dev|test|qa|uat|preview|sandbox|canary)\b"
BLOCKED_PROTOCOLS = r"^(chrome|chrome-extension|about|data):"
URL_NOISE_ATTRIBUTES = "href src srcset action data-href data-url data-link data-src formaction".split()

#: CSS colour names with red, green and blue.
NAMED_COLORS = """
aliceblue 240 248 255; antiquewhite 250 235 215; aqua 0 255 255; aquamarine 127 255 212; azure 240 255 255; beige 245 245 220; bisque 255 228 196
black 0 0 0; blanchedalmond 255 235 205; blue 0 0 255; blueviolet 138 43 226; brown 165 42 42; burlywood 222 184 135; cadetblue 95 158 160
chartreuse 127 255 0; chocolate 210 105 30; coral 255 127 80; cornflowerblue 100 149 237; cornsilk 255 248 220; crimson 220 20 60; cyan 0 255 255
darkblue 0 0 139; darkcyan 0 139 139; darkgoldenrod 184 134 11; darkgray 169 169 169; darkgrey 169 169 169; darkgreen 0 100 0; darkkhaki 189 183 107
darkmagenta 139 0 139; darkolivegreen 85 107 47; darkorange 255 140 0; darkorchid 153 50 204; darkred 139 0 0; darksalmon 233 150 122
darkseagreen 143 188 143; darkslateblue 72 61 139; darkslategray 47 79 79; darkslategrey 47 79 79; darkturquoise 0 206 209; darkviolet 148 0 211
deeppink 255 20 147; deepskyblue 0 191 255; dimgray 105 105 105; dimgrey 105 105 105; dodgerblue 30 144 255; firebrick 178 34 34
floralwhite 255 250 240; forestgreen 34 139 34; fuchsia 255 0 255; gainsboro 220 220 220; ghostwhite 248 248 255; gold 255 215 0; goldenrod 218 165 32
gray 128 128 128; grey 128 128 128; green 0 128 0; greenyellow 173 255 47; honeydew 240 255 240; hotpink 255 105 180; indianred 205 92 92
indigo 75 0 130; ivory 255 255 240; khaki 240 230 140; lavender 230 230 250; lavenderblush 255 240 245; lawngreen 124 252 0; lemonchiffon 255 250 205
lightblue 173 216 230; lightcoral 240 128 128; lightcyan 224 255 255; lightgoldenrodyellow 250 250 210; lightgray 211 211 211; lightgrey 211 211 211
lightgreen 144 238 144; lightpink 255 182 193; lightsalmon 255 160 122; lightseagreen 32 178 170; lightskyblue 135 206 250; lightslategray 119 136 153
lightslategrey 119 136 153; lightsteelblue 176 196 222; lightyellow 255 255 224; lime 0 255 0; limegreen 50 205 50; linen 250 240 230
magenta 255 0 255; maroon 128 0 0; mediumaquamarine 102 205 170; mediumblue 0 0 205; mediumorchid 186 85 211; mediumpurple 147 112 219
mediumseagreen 60 179 113; mediumslateblue 123 104 238; mediumspringgreen 0 250 154; mediumturquoise 72 209 204; mediumvioletred 199 21 133
midnightblue 25 25 112; mintcream 245 255 250; mistyrose 255 228 225; moccasin 255 228 181; navajowhite 255 222 173; navy 0 0 128; oldlace 253 245 230
olive 128 128 0; olivedrab 107 142 35; orange 255 165 0; orangered 255 69 0; orchid 218 112 214; palegoldenrod 238 232 170; palegreen 152 251 152
paleturquoise 175 238 238; palevioletred 219 112 147; papayawhip 255 239 213; peachpuff 255 218 185; peru 205 133 63; pink 255 192 203
plum 221 160 221; powderblue 176 224 230; purple 128 0 128; rebeccapurple 102 51 153; red 255 0 0; rosybrown 188 143 143; royalblue 65 105 225
saddlebrown 139 69 19; salmon 250 128 114; sandybrown 244 164 96; seagreen 46 139 87; seashell 255 245 238; sienna 160 82 45; silver 192 192 192
skyblue 135 206 235; slateblue 106 90 205; slategray 112 128 144; slategrey 112 128 144; snow 255 250 250; springgreen 0 255 127; steelblue 70 130 180
tan 210 180 140; teal 0 128 128; thistle 216 191 216; tomato 255 99 71; turquoise 64 224 208; violet 238 130 238; wheat 245 222 179; white 255 255 255
whitesmoke 245 245 245; yellow 255 255 0; yellowgreen 154 205 50
"""


def named_colors() -> dict[str, str]:
    """Name to rgba() text."""
    rows = (x.split() for x in NAMED_COLORS.replace("\n", ";").split(";") if x.strip())
    return {name: f"rgba({r}, {g}, {b}, 1)" for name, r, g, b in rows}


@dataclass(frozen=True)
class Tolerances:
    color: int = 5
    size: float = 3.0


@dataclass(frozen=True)
class Mode:
    """What a comparison looks at: None stands for everything."""

    name: str
    properties: tuple[str, ...] | None
    attributes: tuple[str, ...] | None
    text: bool
    tolerances: Tolerances


STATIC = Mode("static", None, None, True, Tolerances(5, 3.0))
DYNAMIC = Mode("dynamic", tuple(DYNAMIC_PROPERTIES), tuple(DYNAMIC_ATTRIBUTES), False, Tolerances(8, 5.0))


def mode(name: str) -> Mode:
    """An unknown name gives the static mode."""
    return DYNAMIC if name == "dynamic" else STATIC


@dataclass(frozen=True)
class MatchOptions:
    """orphan_recovery lets the later passes see the orphans of the sequence alignment."""

    look_ahead: int = 5
    suffix_depth: int = 5
    in_sequence: float = 0.99
    suffix: float = 0.85
    min_match: float = 0.70
    confidence_threshold: float = 0.5
    position_tolerance: float = 50.0
    alignment: bool = True
    orphan_recovery: bool = False
    strategies: Mapping[str, float] = field(default_factory=lambda: MappingProxyType({"absolute-hpid": 0.95, "id": 0.90, "css-selector": 0.80, "xpath": 0.78, "position": 0.30}))


def merge_deep(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; mappings are merged, everything else (lists too) is replaced."""
    return {k: merge_deep(base[k], over[k]) if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def validate(options: MatchOptions) -> list[str]:
    """What is wrong with the options; nothing, if they can be used."""
    wrong = [f"{name} must lie between 0 and 1" for name in ("in_sequence", "suffix", "min_match", "confidence_threshold") if not 0 <= getattr(options, name) <= 1]
    wrong += [f"{name} must be positive" for name in ("look_ahead", "suffix_depth", "position_tolerance") if getattr(options, name) <= 0]
    return wrong + [f"confidence of {k} must lie between 0 and 1" for k, v in options.strategies.items() if not 0 <= v <= 1]
