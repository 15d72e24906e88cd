"""Personal data by bootstrapped contextual extraction, in DataFrame functions.

Seeds are the base matches of four kinds (email, ip, card, phone).  The two
words before a seed make a lexical pattern of its kind.  Patterns and
instances (the values they precede) form a graph that is scored in rounds: a
pattern's score is the weight of its instances over all identifier-like tokens
it precedes; a seed weighs 1, any other instance ``1 - prod(1 - score)`` over
the patterns that precede it.
Tokens after a pattern with enough different instances and a high score are
accepted instances, and the contexts they stand in make new patterns in the
next round.  In the end the identifier-like tokens after such patterns that the
base expressions miss are marked, if their shape suits the kind.

Scale: documents are read once, without a shuffle of text; only matches,
tokens with digits or ``@``, and counts of contexts move, and counts combine
before the shuffle.  Both sides of the graph's joins have one row per kind and
context or value, so a hot one doesn't multiply.  The expressions are bounded: look-behinds let a match
start at a run's first character only, so long runs cost linear time.

Edge cases: a null text is empty and has no spans; overlapping kinds each keep
their span; a token that overlaps a base span is never added; repeated rows
are scored once and marked alike; a null doc_id is a document like any other;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SCORE, LEAST_INSTANCES = 0.8, 4

# The contract's expressions.  A run can only match from its first character
# or from where the last match ended (\G), and possessive groups need no stack;
# a card is a whole run of 13 to 19 digits, which is what the greedy form finds.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_CONTEXT = 60  # characters before a match that are searched for its two words

_SPAN = "struct<kind:int,first:int,last:int,value:string,context:string>"


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(items: Column) -> Column:
    """An array cut into parts of about the square root of its size (64 at least)."""
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return _bound(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int"))),
                                              lambda i: F.slice(items, i * n + 1, n)))


def _scanned(items: Column, kind: str, value, join) -> Column:
    """Parts of ``items`` (structs of type ``kind``) as structs (at, items): what
    ``join`` has made of the values before the part, and its items as structs
    (at, item), each with what was made before it.  An array that grows in an
    aggregate is copied at every step, so both levels grow to the square root."""
    pair = f"struct<at:int,item:{kind}>"

    def starts(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda at, x: join(at, value(x))))
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(totals, none, lambda acc, t: F.struct(join(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def inner(part: Column, at: Column) -> Column:
        none = F.struct(at.alias("at"), F.expr(f"cast(array() as array<{pair}>)").alias("out"))
        grown = F.aggregate(part, none, lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("item")))).alias("out")), lambda acc: acc["out"])
        return F.struct(at.alias("at"), grown.alias("items"))

    return _bound(items, lambda xs: _bound(_parts(xs), lambda parts: F.zip_with(parts, starts(parts), inner)))


def _matches(text: Column, regex: str, kind: int) -> Column:
    """All matches as structs (kind, first, last, value, context), in order:
    the texts between matches give the positions."""
    between, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.filter(F.zip_with(between, found, lambda b, v: F.struct(b.alias("before"), v.alias("value"))), lambda p: p["value"].isNotNull())

    def span(x: Column) -> Column:
        before, value = x["item"]["before"], x["item"]["value"]
        first = x["at"] + F.length(before)
        words = F.regexp_extract(F.lower(F.substring(before, -_CONTEXT, _CONTEXT)), r"(\S+\s+\S+)\s+$", 1)
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), (first + F.length(value)).alias("last"), value.alias("value"), F.regexp_replace(words, r"\s+", " ").alias("context"))

    placed = _scanned(pairs, "struct<before:string,value:string>", lambda p: F.length(p["before"]) + F.length(p["value"]), lambda a, b: a + b)
    return F.flatten(F.transform(placed, lambda part: F.transform(part["items"], span))).cast(f"array<{_SPAN}>")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", F.translate(value, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _accept(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind and start."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(_matches(text, BASE[kind], k), _accept(kind))
        parts.append(F.when(F.contains(text, F.lit(HINT[kind])) if kind != "card" else text.rlike("[0-9]"), found).otherwise(none))
    return F.concat(*parts)


def _suits(kind: Column, value: Column) -> Column:
    """Whether a token's shape can be an identifier of the kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    plain = value.rlike(r"^[+(]?[0-9][0-9 ().-]*$")
    return (F.when(kind == 0, value.rlike(r"^[^@\s]+@[^@\s]+$"))
            .when(kind == 1, value.rlike(r"^[0-9]{1,3}(?:[.:][0-9]{1,3}){3}$|^[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){2,7}$"))
            .when(kind == 2, plain & digits.between(13, 19))
            .otherwise(plain & digits.between(7, 15)))


def found_spans(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, row_id, base and tokens: the base spans
    and the identifier-like tokens that overlap none of them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row_id"), base_spans(text).alias("base"),
                       F.when(text.rlike("[0-9@]"), _matches(text, TOKEN, -1)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")).alias("tokens"))

    def meets(s: Column, t: Column) -> Column:
        return (s["first"] < t["last"]) & (t["first"] < s["last"])

    def clear_of(tokens: Column, spans: Column) -> Column:
        return F.filter(tokens, lambda t: ~F.exists(spans, lambda s: meets(s, t)))

    # by parts of the tokens, which are in order: a part is held against the spans that meet its stretch
    clear = _bound(_parts(F.col("tokens")), lambda parts: F.flatten(F.transform(parts, lambda part: F.when(F.size(part) == 0, part).otherwise(_bound(
        F.filter("base", lambda s: (s["first"] < F.element_at(part, -1)["last"]) & (F.get(part, 0)["first"] < s["last"])), lambda spans: clear_of(part, spans))))))
    return rows.select("doc_id", "row_id", "base", clear.alias("tokens"))


def _trusted() -> Column:
    return (F.col("score") >= LEAST_SCORE) & (F.col("instances") >= LEAST_INSTANCES)


def score_patterns(found: DataFrame) -> DataFrame:
    """(kind, context, score, instances) of the patterns, after ROUNDS rounds over
    the graph of patterns and instances.  Rounds after the first weigh the tokens
    by the patterns before them; a token after a trusted pattern is an accepted
    instance, and every context it stands in becomes a pattern of its kind."""
    lowered = [F.col("s.context").alias("context"), F.lower("s.value").alias("value")]
    seeds = found.select(F.explode("base").alias("s")).select("s.kind", *lowered).filter("context <> ''")
    tokens = found.select(F.explode("tokens").alias("s")).select(*lowered).filter("context <> ''")
    sure = written(seeds.groupBy("kind", "context", "value").agg(F.count("*").alias("n"))
                   .groupBy("kind", "context").agg(F.sum("n").alias("sure"), F.count("*").alias("instances")), "edges")
    kinds = F.filter(F.array(*(F.lit(k) for k in range(len(KINDS)))), lambda k: _suits(k, F.col("value")))
    loose = written(tokens.select(F.explode(kinds).alias("kind"), "context", "value").groupBy("kind", "context", "value").agg(F.count("*").alias("n")), "loose")
    volume = written(seeds.select("context").union(tokens.select("context")).groupBy("context").agg(F.count("*").alias("volume")), "volume")
    mass = sure.select("kind", "context", "instances", F.col("sure").cast("double").alias("mass"))
    for last in range(ROUNDS):
        scored = mass.join(volume, "context").select("kind", "context", "instances", F.least(F.lit(1.0), F.col("mass") / F.col("volume")).alias("score"))
        pattern = written(scored, "patterns")
        if last == ROUNDS - 1:
            return pattern
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999))))
        weight = (loose.join(pattern, ["kind", "context"]).groupBy("kind", "value")
                  .agg((1 - F.exp(doubt)).alias("weight"), F.max(_trusted()).alias("accepted")))
        more = (loose.join(weight, ["kind", "value"]).groupBy("kind", "context")
                .agg(F.sum(F.col("n") * F.col("weight")).alias("more"), F.count_if("accepted").alias("accepted")))
        both = sure.join(more, ["kind", "context"], "full").filter("sure is not null or accepted > 0")
        mass = both.select("kind", "context", (F.coalesce("instances", F.lit(0)) + F.coalesce("accepted", F.lit(0))).alias("instances"),
                           (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0.0))).alias("mass"))


def new_spans(found: DataFrame) -> DataFrame:
    """(doc_id, row_id, added): spans that high-confidence patterns discover."""
    good = score_patterns(found).filter(_trusted()).select(F.col("kind").alias("as_kind"), "context")
    tokens = found.select("doc_id", "row_id", F.explode("tokens").alias("s")).select("doc_id", "row_id", "s.*").filter("context <> ''").drop("kind").distinct()
    hits = tokens.join(good, "context").filter(_suits(F.col("as_kind"), F.col("value")))
    span = F.struct(F.col("as_kind").alias("kind"), "first", "last")
    return hits.groupBy("doc_id", "row_id").agg(F.collect_list(span).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, row_id, base, spans: arrays of (kind,
    first, last) in kind then start order; ``spans`` has the discovered ones too."""
    found = written(found_spans(docs), "found")
    added = new_spans(found).withColumnsRenamed({"doc_id": "a_doc", "row_id": "a_row"})
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    rows = found.select("doc_id", "row_id", bare.alias("base"))
    rows = rows.join(added, rows.doc_id.eqNullSafe(added.a_doc) & (rows.row_id == added.a_row), "left")
    return rows.select("doc_id", "row_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    name = F.array(*map(F.lit, KINDS))

    def marked(part: Column) -> Column:
        """The text from the part's start to the end of its last span, with marks."""
        here = F.element_at(part["items"], -1)
        end = F.greatest(here["at"], here["item"]["last"])
        # positions count characters from the text's start, so they are taken in the part's own text
        own = F.substring(text, part["at"] + 1, end - part["at"])

        def piece(x: Column, words: Column) -> Column:
            s = x["item"]
            plain = F.substring(words, x["at"] - part["at"] + 1, s["first"] - x["at"])
            # one that overlaps the span before has no mark of its own
            return F.when(s["first"] < x["at"], F.lit("")).otherwise(F.concat(plain, F.lit("["), F.upper(F.get(name, s["kind"])), F.lit("]")))

        return _bound(own, lambda words: F.array_join(F.transform(part["items"], lambda x: piece(x, words)), ""))

    placed = _scanned(ordered, "struct<first:int,last:int,kind:int>", lambda s: s["last"], F.greatest)
    last = F.array_max(F.transform(spans, lambda s: s["last"]))
    rest = F.concat(F.array_join(F.transform(placed, marked), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _listed(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["first"], s["last"])), ",")


def _of(kind: int):
    return lambda s: s["kind"] == kind


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
