"""Pages as element rows: a tree walk inside tasks, classification as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import hpid as H
from ..functions import text as T
from ..functions import url
from ..shared import written

ELEMENTS = "idx int, hpid string, parent string, dom_path string, depth int, tagName string, elementId string, className string, role string, attributes map<string,string>, textContent string"

# Tags and roles by tier.
T3_TAGS = "button input select textarea label a dialog details output meter progress option optgroup".split()
T3_ROLES = "button link checkbox radio textbox combobox listbox menuitem menuitemcheckbox menuitemradio option searchbox slider spinbutton switch tab treeitem gridcell".split()
T2_TAGS = "p span h1 h2 h3 h4 h5 h6 img svg canvas video audio picture blockquote pre code strong em figure figcaption time address q mark ins del abbr cite dfn kbd samp var small sub sup dl dt dd iframe".split()

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Depth at which a page is refused.
MAX_DEPTH = 5000
#: Characters of an element's own text that are kept.
MAX_TEXT = 500
#: Characters of pages whose elements a task hands on at once.
BATCH_CHARS = 1_000_000
# Where a page's header and footer lie, as shares of its height and of the viewport's.
HEADER_SHARE, HEADER_VIEWPORTS, FOOTER_SHARE, FOOTER_VIEWPORTS = 0.20, 1.5, 0.15, 1.0


class EngineBoundaryError(ValueError):
    """A page is nested too deeply."""


class _Walker(HTMLParser):
    """Elements in document order with paths of sibling numbers; irrelevant tags are left out with all beneath.

    A path counts relevant siblings; dom_path counts all of them, from the body's children down. What a declared shadow root
    (<template shadowrootmode>) holds lies at its host's path and a 0.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[dict] = []
        self.roots = 0
        self.skipped: list[str] = []
        self.nodes: list[list] = []  # text nodes: the element that holds it, its tree and text, and the tags before it
        self.tags = 0

    def shut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for row in self.stack[k:]:
            row["last"], row["to"] = len(self.rows) - 1, len(self.nodes)
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        up = self.stack[-1] if self.stack else None
        if tag == "template" and up and not self.skipped and any(k == "shadowrootmode" for k, _ in attrs):
            self.stack.append({"hpid": f"{up['hpid']}.0", "dom_path": f"{up['dom_path']}.0", "depth": up["depth"], "tagName": tag, "texts": [], "kids": 0, "all": 0, "tree": f"{up['hpid']}.0", "root": True})
            return
        if self.skipped or tag in C.IRRELEVANT_TAGS:
            if not self.skipped and up:
                up["all"] += 1
            if tag not in _VOID:
                self.skipped.append(tag)
            return
        if tag in _CLOSES_P and self.stack and self.stack[-1]["tagName"] == "p":
            self.shut(len(self.stack) - 1)
        elif tag in _SAME and self.stack and self.stack[-1]["tagName"] in _SAME[tag]:
            self.shut(len(self.stack) - 1)
        up = self.stack[-1] if self.stack else None
        if up:
            up["kids"] += 1
            up["all"] += 1
            path = f"{up['hpid']}.{up['kids']}"
            dom = "" if tag == "body" else f"{up['dom_path']}.{up['all']}" if up["dom_path"] else str(up["all"])
        else:
            self.roots += 1
            path, dom = str(self.roots), "" if tag in ("html", "body") else str(self.roots)
        depth = up["depth"] + 1 if up else 0
        if depth >= MAX_DEPTH:
            raise EngineBoundaryError(f"a page is deeper than {MAX_DEPTH} elements")
        held: dict[str, str] = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        row = {"idx": len(self.rows), "hpid": path, "parent": up["hpid"].removesuffix(".0") if up else None, "dom_path": dom, "depth": depth, "tagName": tag, "attributes": held, "texts": [], "kids": 0, "all": 0, "tree": up["tree"] if up else "", "from": len(self.nodes), "to": len(self.nodes), "last": len(self.rows)}
        self.rows.append(row)
        if tag not in _VOID:
            self.stack.append(row)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_comment(self, data: str) -> None:
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tagName"] == tag:
                self.shut(k)
                break

    def close(self) -> None:
        super().close()
        self.shut(0)

    def handle_data(self, data: str) -> None:
        if not self.skipped and self.stack:
            up = self.stack[-1]
            up["texts"].append(data)
            if self.nodes and self.nodes[-1][3] == self.tags:
                self.nodes[-1][2] += data
            else:
                self.nodes.append([up, up["tree"], data, self.tags])


def _own_text(texts: list[str]) -> str | None:
    text = "".join(texts).strip()
    return f"{text[:MAX_TEXT]}..." if len(text) > MAX_TEXT else text or None


#: What path expressions take for white space.
_XML_SPACE, _XML_WORD = re.compile(r"[ \t\r\n]+"), re.compile(r"[^ \t\r\n]+")
#: Longest text of a subtree, or of a single text node, that selectors ask for.
SHORT_TEXT = 200
TREES = "last int, tree string"
TEXTS = "texts array<string>, subtree string, words array<struct<pos:int,word:string,owners:array<struct<at:int,hpid:string>>>>"

_WORDS = pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.string()), ("owners", pa.list_(pa.struct([("at", pa.int32()), ("hpid", pa.string())])))]))
_ARROW = {k: pa.int32() for k in ("idx", "depth", "last")} | {k: pa.string() for k in "hpid parent dom_path tagName elementId className role textContent tree subtree".split()} | {"attributes": pa.map_(pa.string(), pa.string()), "texts": pa.list_(pa.string()), "words": _WORDS}


def _texts(walker: _Walker) -> None:
    """Adds to each row its short text nodes, the text of its subtree if that is short, and the words that begin in it with the
    elements that hold their parts. Subtrees are intervals of text nodes; a shadow tree's text is not its host's.
    """
    before, words, held = [0], {}, {}
    for owner, tree, text, _ in walker.nodes:
        before.append(before[-1] + len(_XML_SPACE.sub("", text)))
        if "root" in owner:  # lies in no element of its tree
            continue
        if len(text) <= SHORT_TEXT:
            owner.setdefault("nodes", []).append(text)
        own = words.setdefault(tree, [])
        for m in _XML_WORD.finditer(text):
            if m.start() or not held.get(tree):
                own.append({"word": m[0], "owners": [{"at": 0, "hpid": owner["hpid"]}], "pos": len(own)})
                owner.setdefault("words", []).append(own[-1])
            else:  # goes on with the word that the text before broke off
                own[-1]["owners"].append({"at": len(own[-1]["word"]), "hpid": owner["hpid"]})
                own[-1]["word"] += m[0]
        held[tree] = bool(text) and text[-1] not in " \t\r\n"
    for row in walker.rows:
        a, b = row["from"], row["to"]
        if before[b] - before[a] <= SHORT_TEXT:
            text = _XML_SPACE.sub(" ", "".join(t for _, tree, t, _ in walker.nodes[a:b] if tree == row["tree"])).strip(" ")
            row["subtree"] = text if len(text) <= SHORT_TEXT else None


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", texts: bool = False, trees: bool = False) -> DataFrame:
    """One row per relevant element of each page, in document order; null and empty pages have none.

    With trees also the last element below and the tree (empty, or the path of a shadow root), which CSS selectors ask for;
    with texts these and what path expressions ask for (see _texts).
    """

    fields = f"{ELEMENTS}, {TREES}, {TEXTS}" if texts else f"{ELEMENTS}, {TREES}" if trees else ELEMENTS
    types = [_ARROW[f.split()[0]] for f in re.split(r", (?=\w+ )", fields)]

    def made(ids: pa.Array, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(places, pa.int64())), *[pa.array(list(x), t) for x, t in zip(columns, types, strict=True)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, rows, chars = batch.column("page_id"), [], [], 0
            for k, page in enumerate(batch.column("html")):
                text = page.as_py() or ""
                walker = _Walker()
                walker.feed(text)
                walker.close()
                if texts:
                    _texts(walker)
                more = (lambda r: (r["last"], r["tree"], r.get("nodes", []), r.get("subtree"), r.get("words", []))) if texts else (lambda r: (r["last"], r["tree"])) if trees else (lambda r: ())
                rows += [(r["idx"], r["hpid"], r["parent"], r["dom_path"], r["depth"], r["tagName"], r["attributes"].get("id"), r["attributes"].get("class"), r["attributes"].get("role"), list(r["attributes"].items()), _own_text(r["texts"]), *more(r)) for r in walker.rows]
                places += [k] * len(walker.rows)
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield made(ids, places, rows)
                    places, rows, chars = [], [], 0
            yield made(ids, places, rows)

    names = ["page_id", *(f.split()[0] for f in re.split(r", (?=\w+ )", fields))]
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, {fields}")


def with_frames(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Elements of pages (page_id, url, html) with those of their frames (page_id, frame_id, frame_url, html) behind them, frame by
    frame: idx goes on, frameId and frameUrl tell where they come from (null for the page's own). Only frames of the page's own
    origin count; frame 0 is the page itself.
    """
    own = elements(pages.select("page_id", "html")).select("*", F.lit(None).cast(frames.schema["frame_id"].dataType).alias("frameId"), F.lit(None).cast("string").alias("frameUrl"))
    near = frames.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id").filter((F.col("frame_id") != 0) & url.same_origin(F.col("page_url"), F.col("frame_url")))
    key = F.struct("page_id", "frame_id", "frame_url").alias("key")
    inner = elements(near.select(key, "html"), "key").select(F.col("page_id").alias("key"), *[c for c in own.columns if c not in ("page_id", "frameId", "frameUrl")])
    inner = inner.select("key.page_id", *[c for c in inner.columns if c != "key"], F.col("key.frame_id").alias("frameId"), F.col("key.frame_url").alias("frameUrl"))
    every = own.unionByName(inner)
    sizes = every.groupBy("page_id", "frameId").agg(F.count("*").alias("n"))
    before = Window.partitionBy("page_id").orderBy(F.col("frameId").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("page_id", F.col("frameId").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("begin"))
    met = every.withColumnRenamed("page_id", "p").join(begins, (F.col("p") == F.col("page_id")) & F.col("frameId").eqNullSafe(F.col("f")))
    return met.withColumn("idx", F.col("idx") + F.col("begin")).select(*own.columns)


def limited(rows: DataFrame, most: int = C.MAX_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """What a report of each page takes up, its first `most` elements in document order, and the overflow: page_id, elements and
    left_out of the pages that have more. Comparisons take reports of any size.
    """
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("idx"))
    over = rows.groupBy("page_id").agg(F.count("*").alias("elements")).filter(F.col("elements") > most).withColumn("left_out", F.col("elements") - most)
    return rows.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place"), over


def wanted_by(filters: Mapping[str, str]) -> Column | None:
    """The elements that filters ask for: class (words of a group all, groups apart by commas), id and tag; any of the three will do. None without filters."""
    classes = F.split(F.trim(F.coalesce("className", F.lit(""))), r"\s+")
    parts: list[Column] = []
    for group in filters.get("class", "").split(","):
        names = [c.removeprefix(".") for c in group.split()]
        if names:
            parts.append(reduce(lambda a, b: a & b, [F.array_contains(classes, n) for n in names]))
    ids = [i.strip().removeprefix("#") for i in filters.get("id", "").split(",") if i.strip()]
    if ids:
        parts.append(F.coalesce(F.col("elementId").isin(ids), F.lit(False)))
    tags = [t.lower() for t in re.split(r"[\s,]+", filters.get("tag", "")) if t]
    if tags:
        parts.append(F.col("tagName").isin(tags))
    return reduce(lambda a, b: a | b, parts) if parts else None


def filtered(rows: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """The subtrees of the topmost elements that filters ask for, numbered anew: the k-th root has the path k; absoluteHpid begins with the root's dom_path.

    Without filters all rows, whose absolute paths are their paths.
    """
    wanted = wanted_by(filters)
    if wanted is None:
        return rows.withColumn("absoluteHpid", F.col("hpid"))
    roots = top_level(rows, wanted).select("page_id", F.col("hpid").alias("root"), F.col("dom_path").alias("root_dom"), F.col("depth").alias("root_depth"), F.row_number().over(Window.partitionBy("page_id").orderBy("idx")).cast("string").alias("k"))
    asked = rows.withColumn("root", F.explode(F.concat(H.ancestors(F.col("hpid")), F.array("hpid"))))
    met = asked.join(roots, ["page_id", "root"])
    rest = F.substring(F.col("hpid"), F.length("root") + 1, F.length("hpid"))
    return met.withColumns({"absoluteHpid": F.concat("root_dom", rest), "hpid": F.concat("k", rest), "depth": F.col("depth") - F.col("root_depth")}).drop("root", "root_dom", "root_depth", "k")


def visible(styles: Column, width: Column, height: Column) -> Column:
    """Whether an element takes part in the picture."""
    value = lambda k: F.coalesce(F.element_at(styles, F.lit(k)), F.lit(""))
    shown = F.coalesce(F.element_at(styles, F.lit("opacity")).try_cast("double"), F.lit(1.0)) > 0
    return (value("display") != "none") & (value("visibility") != "hidden") & shown & (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)


def tracked(styles: Column) -> Column:
    """Only the properties that reports record."""
    return F.map_filter(styles, lambda k, v: k.isin(C.CSS_PROPERTIES))


def inline_styles(attributes: Column) -> Column:
    """Properties of a style attribute, the later of two declarations; what a page without a browser tells of its styles."""
    parts = F.filter(F.split(F.coalesce(F.element_at(attributes, F.lit("style")), F.lit("")), ";"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda x, k: (k > i) & (x["key"] == e["key"]))) == 0)
    return F.map_from_entries(last)


def section_by_position(top: Column, document_height: Column, viewport_height: Column) -> Column:
    """header, main or footer by how far down an element begins."""
    header = F.least(document_height * HEADER_SHARE, viewport_height * HEADER_VIEWPORTS)
    footer = document_height - F.least(document_height * FOOTER_SHARE, viewport_height * FOOTER_VIEWPORTS)
    return F.when(top < header, "header").when(top > footer, "footer").otherwise("main")


def tier(tag: Column, role: Column) -> Column:
    return F.when(tag.isin(C.IRRELEVANT_TAGS), "T0").when(tag.isin(T3_TAGS) | F.coalesce(role, F.lit("")).isin(T3_ROLES), "T3").when(tag.isin(T2_TAGS), "T2").otherwise("T1")


def own_section(tag: Column, role: Column, classes: Column, element_id: Column) -> Column:
    """The section that an element itself names, else null."""
    named = F.concat_ws(" ", F.coalesce(classes, F.lit("")), F.coalesce(element_id, F.lit("")))
    r = F.coalesce(role, F.lit(""))
    said = lambda words: named.rlike(rf"(?i)(^|[^a-z])({words})([^a-z]|$)")
    return (
        F.when((tag == "header") | (r == "banner"), "header").when((tag == "main") | (r == "main"), "main").when((tag == "footer") | (r == "contentinfo"), "footer")
        .when((tag == "nav") | (r == "navigation"), "header").when((tag == "aside") | (r == "complementary"), "main")
        .when(said("header|top|navbar|masthead"), "header").when(said("footer|bottom|copyright"), "footer")
    )


def sections(rows: DataFrame) -> DataFrame:
    """rows with `section`: that of the nearest element at or above that names one, else unknown. html and body name none."""
    named = rows.filter(~F.col("tagName").isin("html", "body")).select("page_id", F.col("hpid").alias("above"), own_section(F.col("tagName"), F.col("role"), F.col("className"), F.col("elementId")).alias("named")).filter("named is not null")
    asked = rows.select("page_id", "hpid", F.explode(F.concat(H.ancestors(F.col("hpid")), F.array("hpid"))).alias("above"))
    nearest = asked.join(named, ["page_id", "above"]).groupBy("page_id", "hpid").agg(F.max_by("named", H.depth(F.col("above"))).alias("section"))
    return rows.join(nearest, ["page_id", "hpid"], "left").withColumn("section", F.coalesce("section", F.lit("unknown")))


def class_key(classes: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != "")), " ")


def with_class_occurrence(rows: DataFrame, owner: str = "page_id") -> DataFrame:
    """rows with the number of elements of the same owner that carry the same classes; 0 without classes."""
    keyed = rows.withColumn("__classes", class_key(F.col("className")))
    counted = F.count("*").over(Window.partitionBy(owner, "__classes"))
    return keyed.withColumn("classOccurrenceCount", F.when(F.col("__classes") == "", 0).otherwise(counted)).drop("__classes")


def child_tags(rows: DataFrame, most: int = 10) -> DataFrame:
    """The tags of each element's children in the order in which they first occur, with their number where it is above 1."""
    return _children(rows, most).select("page_id", "hpid", "children")


def _children(rows: DataFrame, most: int = 10) -> DataFrame:
    """page_id, hpid, children (see child_tags) and childrenCount of each element that has any."""
    counts = rows.filter("parent is not null").groupBy("page_id", "parent", "tagName").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    named = F.concat("tagName", F.when(F.col("n") > 1, F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")"))).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("first", named.alias("t"))))  # a row per tag name
    return counts.groupBy("page_id", F.col("parent").alias("hpid")).agg(F.array_join(F.transform(F.slice(parts, 1, most), lambda x: x["t"]), ", ").alias("children"), F.sum("n").alias("childrenCount"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Each element's parent, siblings and children: parent, previousSibling, nextSibling (as labels), childrenCount, childrenTypes.

    Joins are told not to broadcast: columns of elements are so alike that Spark takes the written file, a hundredth of the rows
    in memory, for a small table and would gather it at the driver.
    """
    ref = T.element_ref(F.col("tagName"), F.col("elementId"), F.col("className"))
    named = written(rows.select("page_id", "idx", "hpid", "parent", "tagName", ref.alias("ref")), "named")  # pages are parsed once
    beside = Window.partitionBy("page_id", "parent").orderBy("idx")
    found = named.withColumns({"previousSibling": F.lag("ref").over(beside), "nextSibling": F.lead("ref").over(beside)}).drop("tagName", "ref")
    up = named.select("page_id", F.col("hpid").alias("parent"), F.col("ref").alias("parent_ref"))
    met = found.join(up.hint("merge"), ["page_id", "parent"], "left").join(_children(named).hint("merge"), ["page_id", "hpid"], "left")
    return met.select("page_id", "idx", "hpid", F.col("parent_ref").alias("parent"), "previousSibling", "nextSibling", F.coalesce("childrenCount", F.lit(0)).alias("childrenCount"), F.split(F.col("children"), ", ").alias("childrenTypes"))


def class_hierarchy(rows: DataFrame, parents: int = 3, children: int = 10, classes: int = 2) -> DataFrame:
    """Tag and first classes of the nearest ancestors (at most `parents` up) and of the first children that have classes."""
    names = F.slice(F.filter(F.split(F.trim(F.coalesce("className", F.lit(""))), r"\s+"), lambda c: c != ""), 1, classes)
    classed = rows.select("page_id", "hpid", "parent", "idx", F.struct(F.col("tagName").alias("tag"), names.alias("classes")).alias("own")).filter(F.size("own.classes") > 0)
    steps = F.slice(F.reverse(H.ancestors(F.col("hpid"))), 1, parents)
    asked = rows.select("page_id", "hpid", F.posexplode(steps).alias("up", "above"))
    above = asked.join(classed.select("page_id", F.col("hpid").alias("above"), "own"), ["page_id", "above"])
    ordered = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "own"))), lambda x: x["own"])
    ups = above.groupBy("page_id", "hpid").agg(ordered("up").alias("parentClasses"))
    first = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("idx"))
    downs = classed.withColumn("k", first).filter(F.col("k") <= children).groupBy("page_id", F.col("parent").alias("hpid")).agg(ordered("k").alias("childClasses"))
    return rows.select("page_id", "idx", "hpid").join(ups, ["page_id", "hpid"], "left").join(downs, ["page_id", "hpid"], "left")


def sibling_ordinals(rows: DataFrame) -> DataFrame:
    """rows with nth (among all siblings), nth_of_type and of_type (siblings of the same tag)."""
    beside, same = Window.partitionBy("page_id", "parent").orderBy("idx"), Window.partitionBy("page_id", "parent", "tagName")
    return rows.withColumns({"nth": F.row_number().over(beside), "nth_of_type": F.row_number().over(same.orderBy("idx")), "of_type": F.count("*").over(same)})


def top_level(rows: DataFrame, wanted: Column) -> DataFrame:
    """Wanted elements without those that lie beneath another wanted one."""
    found = rows.filter(wanted)
    keys = found.select("page_id", F.col("hpid").alias("above"))
    beneath = found.select("page_id", "hpid", F.explode(H.ancestors(F.col("hpid"))).alias("above")).join(keys, ["page_id", "above"], "left_semi").select("page_id", "hpid").distinct()
    return found.join(beneath, ["page_id", "hpid"], "left_anti")


def without_framework_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: ~k.rlike("|".join(f"(?:{p})" for p in C.FRAMEWORK_ATTRIBUTES)))
