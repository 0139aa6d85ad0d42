"""A plain evaluator of selectors, and the tiers of XPath and CSS tried one by one on one page: what tests hold the queries against."""

import re

from sightline import config as C
from sightline.sources.html import _Walker

SPACE = re.compile(r"[ \t\r\n]+")


class Page:
    def __init__(self, html):
        walker = _Walker()
        walker.feed(html or "")
        walker.close()
        self.rows = walker.rows
        by = {r["hpid"]: r for r in self.rows}
        for r in self.rows:
            r["up"] = by.get(r["parent"]) if r["parent"] and by[r["parent"]]["tree"] == r["tree"] else None
            r["kids"], r["nodes"], r["all_text"] = [], [], []
        for r in self.rows:
            if r["up"]:
                r["up"]["kids"].append(r)
        for owner, tree, text, _ in walker.nodes:
            if "root" not in owner:
                owner["nodes"].append(text)
            at = owner
            while at is not None and "root" not in at:
                at["all_text"].append(text)
                at = at["up"]
        self.trees = {}
        for r in self.rows:
            r["norm"] = SPACE.sub(" ", "".join(r["all_text"])).strip(" ")
            self.trees.setdefault(r["tree"], []).append(r)

    def above(self, r):
        out, at = [], r["up"]
        while at:
            out.append(at)
            at = at["up"]
        return out


LITERAL = r"""(?:concat\((?:'[^']*'|"[^"]*"|, )*\)|'[^']*'|"[^"]*")"""
STEP = re.compile(rf"(//|/)(following-sibling::|preceding-sibling::)?([\w:-]+)((?:\[(?:{LITERAL}|[^\]'\"])*\])*)")
TEST = re.compile(rf"\[((?:{LITERAL}|[^\]'\"])*)\]")


def literal(x):
    return "".join(p[1:-1] for p in re.findall(r"""'[^']*'|"[^"]*\"""", x))


def holds(r, test):
    for part in re.split(r" and (?=@|contains)", test):
        if m := re.fullmatch(rf"@([\w:.-]+)=({LITERAL})", part):
            ok = r["attributes"].get(m[1]) == literal(m[2])
        elif m := re.fullmatch(rf"text\(\)=({LITERAL})", part):
            ok = literal(m[1]) in r["nodes"]
        elif m := re.fullmatch(rf"normalize-space\(\.\)=({LITERAL})", part):
            ok = r["norm"] == literal(m[1])
        elif m := re.fullmatch(rf"contains\(normalize-space\(\.\), ({LITERAL})\)", part):
            ok = literal(m[1]) in r["norm"]
        elif m := re.fullmatch(rf"contains\(@class,({LITERAL})\)", part):
            ok = literal(m[1]) in r["attributes"].get("class", "")
        else:
            raise ValueError(part)
        if not ok:
            return False
    return True


def xpath(rows, path):
    """The rows of one tree that a path expression of these tiers selects, in document order."""
    if m := re.fullmatch(r"\((.*)\)\[(\d+)\]", path, re.S):
        return xpath(rows, m[1])[int(m[2]) - 1 : int(m[2])]
    assert "".join(m[0] for m in STEP.finditer(path)) == path, path
    at = [None]
    for axis, sibling, tag, tests in STEP.findall(path):
        found = []
        for x in at:
            if sibling:
                near = [r for r in rows if r["up"] is x["up"] and (r["idx"] > x["idx"]) == (sibling[0] == "f") and r is not x]
                pool = [near if sibling[0] == "f" else near[::-1]]
            elif axis == "/":
                pool = [x["kids"] if x else [r for r in rows if r["up"] is None]]
            else:  # positions count within each parent
                below = [r for r in rows if x is None or x["idx"] < r["idx"] <= x["last"]]
                groups = {}
                for r in below:
                    groups.setdefault(id(r["up"]), []).append(r)
                pool = list(groups.values())
            for group in pool:
                own = [r for r in group if r["tagName"] == tag]
                for test in TEST.findall(tests):
                    own = own[int(test) - 1 : int(test)] if test.isdigit() else [r for r in own if holds(r, test)]
                found += own
        at = sorted({r["idx"]: r for r in found}.values(), key=lambda r: r["idx"])
    return at


def css_parts(selector):
    """(combinator, compound) of each part; spaces within quotes don't count."""
    return re.findall(r"""(?:^|( > | ))((?:"(?:\\.|[^"])*"|\\[0-9a-f]+ |\\.|[^\s"\\])+)""", selector)


COMPOUND = re.compile(r"""\#((?:\\[0-9a-f]+\ |\\.|[^.\[:\\\#])+)|\.((?:\\[0-9a-f]+\ |\\.|[^.\[:\\\#])+)|\[([\w:.-]+)="((?:\\.|[^"\\])*)"\]|:(nth-child|nth-of-type)\((\d+)\)|:(disabled|required|checked|read-only)|^([\w-]+)""", re.X)


def unescape(x):
    return re.sub(r"\\([0-9a-f]+) |\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], x)


def fits(r, compound):
    assert "".join(m[0] for m in COMPOUND.finditer(compound)) == compound, compound
    for i, c, name, value, nth, n, flag, tag in COMPOUND.findall(compound):
        kin = [x for x in r["beside"] if nth != "nth-of-type" or x["tagName"] == r["tagName"]]
        ok = (
            r["attributes"].get("id") == unescape(i) if i else unescape(c) in r["attributes"].get("class", "").split() if c else r["attributes"].get(name) == unescape(value) if name
            else kin.index(r) + 1 == int(n) if nth else {"read-only": "readonly"}.get(flag, flag) in r["attributes"] if flag else r["tagName"] == tag
        )
        if not ok:
            return False
    return True


def css(rows, selector):
    for r in rows:
        r.setdefault("beside", r["up"]["kids"] if r["up"] else [x for x in rows if x["up"] is None])
    parts = css_parts(selector)
    assert "".join(a + b for a, b in parts) == selector, selector

    def ends(r, k):
        if not fits(r, parts[k][1]):
            return False
        if not k:
            return True
        if parts[k][0] == " > ":
            return r["up"] is not None and ends(r["up"], k - 1)
        up = r["up"]
        while up is not None:
            if ends(up, k - 1):
                return True
            up = up["up"]
        return False

    return [r for r in rows if ends(r, len(parts) - 1)]


def matches(patterns, x):
    return any(re.search(p, x) for p in patterns)


def stable_id(x):
    return bool(x) and 2 <= len(x) <= 200 and not matches(C.DYNAMIC_IDS, x)


def stable_value(x):
    return bool(x) and len(x) <= 200 and not matches(C.UNSTABLE_VALUES, x)


def static_text(x):
    return 2 <= len(x) <= 200 and not matches(C.DYNAMIC_TEXTS, x)


def quote(x):
    return f"'{x}'" if "'" not in x else f'"{x}"' if '"' not in x else "concat(" + ", \"'\", ".join(f"'{p}'" for p in x.split("'")) + ")"


TESTED = C.SELECTOR_TEST_ATTRIBUTES
LISTED = [*C.ANCHOR_ATTRIBUTES, "role", "type", "href", "for", "value", "placeholder", "name", "aria-label", "class"]


def best_attributes(r):
    held = r["attributes"]
    return [(n, held[n]) for n in [*LISTED, *[n for n in held if n.startswith("data-") and n not in LISTED]] if stable_value(held.get(n))]


def xpath_tiers(page, r):
    """(tier, selector, what follows the tag or None) in the order of tiers."""
    tag, held, up = r["tagName"], r["attributes"], page.above(r)
    text = re.sub(r"\s+", " ", r["norm"]).strip()
    own = lambda tier, test: (tier, f"//{tag}[{test}]", f"[{test}]")
    anc = lambda a, n, v: f"//{a['tagName']}[@{n}={quote(v)}]"
    if static_text(text) and len(text) <= 150:
        yield own(0, f"text()={quote(text)}")
    for n in TESTED:
        if stable_value(held.get(n)):
            yield own(1, f"@{n}={quote(held[n])}")
    if stable_id(held.get("id")):
        yield own(2, f"@id={quote(held['id'])}")
    if static_text(text) and len(text) <= 150:
        yield own(3, f"normalize-space(.)={quote(text)}")
    for n, v in best_attributes(r)[:3]:
        yield own(4, f"@{n}={quote(v)}")
    for n in [n for n in held if n.startswith("data-")][:3]:
        if stable_value(held[n]):
            yield own(5, f"@{n}={quote(held[n])}")
    tags = "form nav header footer main section article aside dialog table fieldset figure".split()
    semantic = next((a for a in up[:8] if a["tagName"] in tags and best_attributes(a)), None)
    if semantic and stable_id(semantic["attributes"].get("id")):
        yield 6, f"{anc(semantic, 'id', semantic['attributes']['id'])}//{tag}", ""
    beside = r["up"]["kids"] if r["up"] else [x for x in page.trees[r["tree"]] if x["up"] is None]
    k = beside.index(r)
    for at, axis in ((k - 1, "following"), (k + 1, "preceding")):
        if 0 <= at < len(beside) and stable_id(beside[at]["attributes"].get("id")):
            yield 8, f"{anc(beside[at], 'id', beside[at]['attributes']['id'])}/{axis}-sibling::{tag}[1]", None
    chain = next((a for a in up[:3] if best_attributes(a)), None)
    if chain:
        i = chain["attributes"].get("id")
        yield 9, f"{anc(chain, *(('id', i) if stable_id(i) else best_attributes(chain)[0]))}//{tag}", ""
    if held.get("type") and stable_value(held.get("name")):
        yield own(10, f"@type={quote(held['type'])} and @name={quote(held['name'])}")
    if held.get("aria-label") and len(held["aria-label"]) < 100:
        yield own(11, f"@aria-label={quote(held['aria-label'])}")
    if 5 <= len(text) <= 200 and static_text(text) and len(text.split()) >= 2 and len(phrase := " ".join(text.split()[:4])) >= 5:
        yield own(12, f"contains(normalize-space(.), {quote(phrase)})")
    if r["up"] and stable_id(r["up"]["attributes"].get("id")):
        same = [x for x in beside if x["tagName"] == tag]
        yield 13, f"{anc(r['up'], 'id', r['up']['attributes']['id'])}/{tag}" + ("" if len(same) == 1 else f"[{same.index(r) + 1}]"), None
    unstable = [r"^Mui[A-Z]", r"^makeStyles-", r"(?i)^css-[a-z0-9]+$", r"^jss\d+$", r"^sc-", r"^emotion-", r"(?i)lwc-", r"(?i)^_[a-z0-9]{5,}$"]
    classes = [c for c in held.get("class", "").split() if len(c) >= 2 and not matches(unstable, c)]
    if classes:
        yield own(14, f"contains(@class,{quote(classes[0])})")
    lender = next((a for a in up[:5] if best_attributes(a)), None)
    if lender:
        yield 15, f"{anc(lender, *best_attributes(lender)[0])}//{tag}", ""
    for tier, n, most in ((16, "role", 10**9), (17, "href", 200), (17, "src", 200), (18, "alt", 150), (18, "title", 150)):
        if held.get(n) and len(held[n]) < most and not (n == "href" and held[n].startswith("javascript:")):
            yield own(tier, f"@{n}={quote(held[n])}")
    path = []
    for x in [r, *up]:
        kin = [y for y in (x["up"]["kids"] if x["up"] else [z for z in page.trees[r["tree"]] if z["up"] is None]) if y["tagName"] == x["tagName"]]
        path.append(x["tagName"] + (f"[{kin.index(x) + 1}]" if len(kin) > 1 else ""))
    yield 19, "/" + "/".join(path[::-1]), None


def choose_xpath(page, r):
    rows = page.trees[r["tree"]]
    anchor = None
    for a in page.above(r)[:6]:
        if stable_id(a["attributes"].get("id")):
            anchor = ("id", a)
        else:
            anchor = next(((n, a) for n in TESTED if a["attributes"].get(n)), None)
        if anchor:
            break
    for tier, path, tail in xpath_tiers(page, r):
        found = xpath(rows, path)
        if not any(x is r for x in found):
            continue
        if len(found) == 1:
            return tier, path
        if tail is not None and anchor:
            n, a = anchor
            narrow = f"//{a['tagName']}[@{n}={quote(a['attributes'][n])}]//{r['tagName']}{tail}"
            near = xpath(rows, narrow)
            return tier, narrow if len(near) == 1 else f"({narrow})[{[x is r for x in near].index(True) + 1}]"
        return tier, f"({path})[{[x is r for x in found].index(True) + 1}]"
