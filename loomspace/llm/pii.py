"""Personal data by bootstrapped contextual extraction.

Four plain expressions find e-mail addresses, IP addresses, card and phone numbers; these are
the seeds.  The words before a seed are its lexical patterns: the last one, and the last two.
Beside the seeds a text holds candidates, which have the shape of an identifier but fail the
plain expression: addresses without a top-level domain or with a spelled-out at sign, IPv6 and
dotted numbers, digits that fail the check sum or lack the plus sign.  Patterns and instances
(values of seeds and candidates) form a graph, aggregated over all documents.  Round by round

- a pattern's confidence is the sum of its instances' scores over the number of its distinct
  instances; it is accepted from `confidence` on, where `support` distinct instances are known
  and at least `usual` of all places where its words stand in any document lead to one of them;
- an instance's score is one less the product of (1 - confidence) of its accepted patterns; it
  is accepted from `confidence` on, and counts as known in the next round.

Rounds end when no pattern is new, or after `rounds`.  All places of an accepted instance are
spans.  Numbers of words in all documents are counted in Spark, for the words of supported
patterns alone.

Defined results: a null text is the empty text and holds nothing.  A candidate never overlaps a
span of a plain expression.  An instance accepted as two kinds is of the better score, the
first in the order e-mail, ip, card, phone where equal.  A value counts once for a pattern,
however many copies of a document hold it; rows are kept as they come.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, slices, trim, whole_text, written

# Fixed values of the contract: kinds in their order, and what each is made of.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]+", r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# A run that no domain follows is passed at once: what begins inside it has none either, and a long text takes linear time.
_EMAIL = re.compile(f"{LOCAL}({DOMAIN})?")
_IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Shapes of candidates.
_AT = re.compile(LOCAL + r"((?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)*)?", re.I)
_V6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"\+?\(?[0-9]+(?:[\x20.()/-]{1,2}[0-9]+)*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[^0-9]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONGEST_WORD, WINDOW = 40, 90
WHITE = r"[ \t\n\x0B\f\r]+"
_PLAIN = str.maketrans(UPPER + "123456789", LOWER + "0" * 9)

SUPPORT, CONFIDENCE, USUAL, ROUNDS = 5, 0.8, 0.2, 4
SENT = 500_000
SCHEMA = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, seen array<struct<kind:int,start:int,end:int,value:string,known:boolean,near:string,far:string>>"


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain expressions, by kind and start."""
    out = []
    if "@" in text:
        out += [(EMAIL, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text):
        # Leading zeros don't change a part's value.
        if m[1] and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and _luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, apart and in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what has an identifier's shape and overlaps no base span; a number may be of two kinds."""
    out: list[tuple[int, int, int]] = []

    def of(shape: re.Pattern, kinds) -> None:
        """Matches of a shape that stand apart from letters, digits and all that was found before."""
        starts, ends = _merged([(s, e) for _, s, e in base] + [(s, e) for _, s, e in out])
        for m in shape.finditer(text):
            s, e = m.span()
            if own := kinds(m):
                k = bisect_right(ends, s)
                if (k == len(ends) or e <= starts[k]) and not text[e : e + 1].isalnum() and not (s and text[s - 1].isalnum()):
                    out.extend((kind, s, e) for kind in own)

    def number(m: re.Match) -> tuple[int, ...]:
        if m[0].count(".") == 3 and _DOTTED.fullmatch(m[0]):
            return (IP,)
        n = len(_DIGITS.sub("", m[0]))
        return ((CARD,) if 12 <= n <= 19 else ()) + ((PHONE,) if 7 <= n <= 15 else ())

    if "@" in text or "[at]" in text or "(at)" in text:
        of(_AT, lambda m: (EMAIL,) if m[1] else ())
    if ":" in text:
        of(_V6, lambda m: (IP,) if len(m[0]) > 4 and ("::" in m[0] or m[0].count(":") == 7) else ())
    of(_NUMBER, number)
    return out


def value(kind: int, found: str) -> str:
    """What tells instances apart: digits, or the address in lower case without its brackets and spaces."""
    if kind in (CARD, PHONE):
        return _DIGITS.sub("", found)
    return re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?[\[(]at[\])]\x20?", "@", found.lower()))


def context(text: str, start: int) -> tuple[str | None, str | None]:
    """The last word before a place, and the last two, with A-Z in lower case and digits as 0; none where they are too long."""
    words = _WORDS.findall(text[max(0, start - WINDOW) : start].translate(_PLAIN))[-2:]
    if not words or len(words[-1]) > LONGEST_WORD:
        return None, None
    return words[-1], (" ".join(words) if len(words) == 2 and len(words[0]) <= LONGEST_WORD else None)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([*span, ("value", pa.string()), ("known", pa.bool_()), ("near", pa.string()), ("far", pa.string())])
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(span), pa.list_(seen)]
    part: list[tuple] = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), types)], names=[c.split()[0] for c in re.findall(r"\w+ (?:long|string|array)", SCHEMA)])

    for doc_id, text in slices(batches):
        base = base_spans(text)
        more = candidates(text, base)
        every = [(k, s, e, value(k, text[s:e]), known, *context(text, s)) for own, known in ((base, True), (more, False)) for k, s, e in own]
        counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        names = [f.name for f in seen]
        part.append((number, doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), [dict(zip(names, b)) for b in base], [dict(zip(names, x)) for x in every if x[-2] is not None or not x[4]]))
        number += 1
        if len(part) >= 2000:
            yield told()
            part.clear()
    if part:
        yield told()
    trim()


def _words_of(text: Column) -> Column:
    """All words of a text as `context` writes them."""
    return F.filter(F.split(F.translate(text, UPPER + "123456789", LOWER + "0" * 9), WHITE), lambda w: w != "")


def _usage(docs: DataFrame, patterns: DataFrame, text_col: str, sent: int) -> DataFrame:
    """pattern, places: how often the words of each pattern stand in all documents."""
    words = docs.select(F.explode(F.array(_words_of(whole_text(text_col)))).alias("w"))
    two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    every = words.select(F.explode(F.concat(F.col("w"), two)).alias("pattern"))
    wanted = patterns.select("pattern").distinct()
    if wanted.limit(sent + 1).count() <= sent:
        every = every.join(F.broadcast(wanted), "pattern", "left_semi")
    return every.groupBy("pattern").agg(F.count("pattern").alias("places"))


def bootstrap(docs: DataFrame, seen: DataFrame, text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, usual: float = USUAL, rounds: int = ROUNDS, sent: int = SENT) -> tuple[DataFrame | None, DataFrame | None]:
    """Accepted instances (kind, value, score) that no plain expression finds, and accepted patterns (kind, pattern, confidence).

    seen: kind, value, known, near, far of every seed and candidate.  None where no pattern is accepted.
    """
    edges = seen.select("kind", "value", "known", F.explode(F.array("near", "far")).alias("pattern")).where("pattern IS NOT NULL")
    edges = edges.groupBy("kind", "pattern", "value").agg(F.count("known").alias("n"), F.max("known").alias("known"))
    by_pattern = edges.groupBy("kind", "pattern").agg(F.count("value").alias("size"), F.sum("n").alias("met")).where(F.col("size") >= support)
    edges = written(edges.join(by_pattern, ["kind", "pattern"]), "edges")
    supported = edges.select("kind", "pattern").distinct()
    if supported.isEmpty():
        return None, None
    usage = _usage(docs, supported, text_col, sent)
    # What stands before an identifier without a space isn't a word of its own: it is met as often as it was seen.
    edges = written(edges.join(usage, "pattern", "left").withColumn("places", F.greatest(F.coalesce("places", F.lit(0)), "met")), "edges")
    score, patterns, before = edges.where("known").select("kind", "value").distinct().withColumn("score", F.lit(1.0)), None, 0
    for _ in range(rounds):
        held = edges.drop("known").join(score, ["kind", "value"], "left")
        judged = held.groupBy("kind", "pattern", "size", "places").agg(F.sum("score").alias("sum"), F.count("score").alias("hits"), F.sum(F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)).alias("led"))
        judged = judged.select("kind", "pattern", (F.col("sum") / F.col("size")).alias("confidence"), (F.col("led") / F.col("places")).alias("share"), "hits")
        patterns = written(judged.where((F.col("hits") >= support) & (F.col("confidence") >= confidence) & (F.col("share") >= usual)), "patterns")
        now = patterns.count()
        if now == before:
            break
        before = now
        miss = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))
        new = edges.where(~F.col("known")).join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(miss))).alias("score")).where(F.col("score") >= confidence)
        seeds = edges.where("known").select("kind", "value").distinct()
        score = written(seeds.withColumn("score", F.lit(1.0)).unionByName(new.join(seeds, ["kind", "value"], "left_anti")), "scores")
    if not before:
        return None, None
    return score.join(edges.where("known").select("kind", "value").distinct(), ["kind", "value"], "left_anti"), patterns


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; spans holds the discovered ones, too."""
    rows = written(docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(_scan, SCHEMA), "spans")
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    found, _ = bootstrap(docs, seen, text_col, sent=sent, **options)
    if found is None:
        rows = rows.withColumn("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    else:
        found = written(found, "found")
        best = F.max_by("kind", F.struct("score", -F.col("kind")))
        place = seen.where("NOT known").select("row", "kind", "start", "end", "value").join(F.broadcast(found) if found.limit(sent + 1).count() <= sent else found, ["kind", "value"])
        place = place.groupBy("row", "start", "end").agg(best.alias("kind"))
        # A row's own spans come together, no more.
        rows = rows.join(place.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")), "row", "left")
    name = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))
