"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

DataFrame functions only. For each kind the text is split at the kind's matches; the lengths of pieces and
matches give each span's place in code points. The places are summed in blocks, so that a text with very many
matches costs its length and not its square.

Base kinds (email, ip, card, phone) stay whenever their validator holds, whatever their score; the other kinds
(iban with mod-97, ssn, secret) need a score of MIN_SCORE, which a checksum or a context word brings.

Defined results
* null and empty texts have no spans; redaction leaves them as they are;
* spans of different kinds may overlap; those of one kind never do;
* repeated rows are judged alike; an empty table gives an empty result; no other column is looked at by find_pii,
  and redact_pii replaces the text column alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Score that a span of an added kind needs.
MIN_SCORE = 0.5
#: Code points before and after a match in which context words count.
CONTEXT = 40
#: Matches whose places are summed at once.
BLOCK = 512


@dataclass(frozen=True)
class Kind:
    """pattern: equal to the plain pattern named in the comment beside it, written so that no text makes it backtrack for long."""

    name: str
    pattern: str
    hint: str  # a cheap pattern without which no match exists
    base: bool
    score: float
    context: str
    least: int  # fewest code points from the start of a match to that of the next


#: A run's first character, or the place where the match before ended.
_FRESH = r"(?:(?<![{0}])|\G)"

KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", _FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++", "@", True, 0.9, r"mail|contact|kontakt|correo|courriel", 5),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", _FRESH.format("0-9") + r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", r"[0-9]\.[0-9]", True, 0.6, r"\bip\b|address|host|server|adresse", 7),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9]([\x20-]?[0-9])++", r"[0-9]{2}", True, 0.6, r"card|visa|credit|karte|carte|tarjeta", 3),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, r"phone|tel|call|mobile|fax", 3),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+\b", r"[A-Z]{2}[0-9]{2}", False, 0.3, r"iban|account|konto|compte|cuenta", 15),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]-[0-9]", False, 0.3, r"ssn|social|security", 11),
    Kind("secret", r"\b[A-Za-z0-9_+/=-]{24,}+", r"[A-Za-z0-9_+/=-]{24}", False, 0.3, r"token|secret|password|passwd|api.?key|credential", 24),
]

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"


def luhn_holds(digits: Column) -> Column:
    """Luhn's check of a string of up to 20 digits."""
    padded = F.lpad(digits, 20, "0")  # zeros in front add nothing
    total = F.lit(0)
    for i in range(1, 21):
        digit = F.substring(padded, i, 1)
        total = total + (F.translate(digit, "0123456789", "0246813579") if i % 2 else digit).cast("int")
    return total % 10 == 0


def mod97_holds(iban: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, "(?!^)"), lambda c: c != ""), F.lit(0), lambda acc, c: step(acc, c).cast("int")) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return count.between(13, 19) & luhn_holds(digits)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        return mod97_holds(F.regexp_replace(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$")
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _checksummed(kind: str) -> bool:
    return kind in ("card", "iban")


def _ends(piece: Column) -> Column:
    """Length and both ends of a match, or of the text between two."""
    return F.struct(F.length(piece).alias("n"), F.lower(F.substring(piece, 1, CONTEXT)).alias("head"), F.lower(F.right(piece, F.lit(CONTEXT))).alias("tail"))


def _near(parts: Column, i: Column, kind: Kind) -> Column:
    """The CONTEXT code points before and after match i, whatever lies there: they reach past as many matches as fit in."""
    reach = -(-CONTEXT // kind.least)
    before = lambda: F.array_join(F.slice(parts["back"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), "")
    after = lambda: F.array_join(F.slice(parts["on"], i + 2, F.lit(reach)), "")
    left, right = F.get(parts["ends"], i), F.get(parts["ends"], i + 1)
    head = F.when(left["n"] >= CONTEXT, left["tail"]).otherwise(F.right(F.concat(before(), left["tail"]), F.lit(CONTEXT)))
    tail = F.when(right["n"] >= CONTEXT, right["head"]).otherwise(F.substring(F.concat(right["head"], after()), 1, CONTEXT))
    return F.concat_ws(" ", head, tail)


def _hits(text: Column, kind: Kind) -> Column:
    """Gap before, length, validity and score of each match of a kind."""

    def hit(parts: Column, match: Column, i: Column) -> Column:
        score = F.lit(kind.score) + (0.4 if _checksummed(kind.name) else 0.0) + F.when(_near(parts, i, kind).rlike(kind.context), 0.3).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
        valid = _valid(kind.name, match)
        return F.struct(F.get(parts["ends"], i)["n"].alias("gap"), F.length(match).alias("n"), (valid if kind.base else valid & (score >= MIN_SCORE)).alias("ok"), score.alias("score"))

    def parts(ends: Column, own: Column) -> Column:
        """ends, and for each match the end of the text up to it (its gap and itself) and the beginning of the text from it on (itself and the next gap)."""
        back = F.transform(own, lambda m, i: F.concat(F.get(ends, i)["tail"], m["tail"]))
        on = F.transform(own, lambda m, i: F.concat(m["head"], F.get(ends, i + 1)["head"]))
        return F.struct(ends.alias("ends"), back.alias("back"), on.alias("on"))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    bound = lambda found, ends: let(let(F.transform(found, _ends), lambda own: parts(ends, own)), lambda p: F.transform(found, lambda m, i: hit(p, m, i)))
    return let(matches, lambda found: let(F.transform(F.split(text, kind.pattern, -1), _ends), lambda ends: bound(found, ends)))


def _spans(text: Column, kind: Kind) -> Column:
    """Valid matches of a kind as spans: places are summed within blocks, then the blocks' own beginnings are added."""
    span = "struct<kind:string,start:int,end:int,score:double>"
    none = F.expr(f"cast(array() as array<{span}>)")

    def add(acc: Column, hit: Column) -> Column:
        begin = acc["at"] + hit["gap"]
        made = F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), (begin + hit["n"]).alias("end"), hit["score"].alias("score"))
        return F.struct((begin + hit["n"]).alias("at"), F.when(hit["ok"], F.concat(acc["spans"], F.array(made))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    blocks = lambda hits: F.transform(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(BLOCK)), lambda b: F.aggregate(F.slice(hits, b + 1, BLOCK), zero, add))

    def move(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["score"].alias("score")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["all"], F.array(moved)).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{span}>>)").alias("all"))
    placed = lambda hits: F.when(F.size(hits) > 0, F.flatten(F.aggregate(blocks(hits), start, move, lambda acc: acc["all"]))).otherwise(none)
    return F.when(text.rlike(kind.hint), let(_hits(text, kind), placed)).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end, score) by kind as KINDS lists them, then by start; ends are exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.concat(*[_spans(text, k) for k in KINDS]).alias("spans"))


def _redacted(text: Column, kind: Kind) -> Column:
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    put = F.zip_with(matches, _hits(text, kind), lambda m, h: F.when(h["ok"], F.lit(f"[{kind.name.upper()}]")).otherwise(m))
    whole = F.array_join(F.zip_with(F.split(text, kind.pattern, -1), put, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(kind.hint), whole).otherwise(text)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span's text replaced by its kind in brackets, kind by kind.

    Each kind's result is bound once: written out, the expression would grow as a power of the number of kinds wherever
    a filter on the new text is pushed below.
    """
    text = F.col(text_col)
    for kind in KINDS:
        text = let(text, lambda t: _redacted(t, kind))  # noqa: B023
    return docs.withColumn(text_col, text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k.name for k in KINDS if k.base]
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")  # of the spans, in their order
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores)
