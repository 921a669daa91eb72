"""Personal data: patterns, and terms that give protected entities away, with built-in expressions.

The base finds e-mail and IP addresses, card and phone numbers by pattern and checks each match.
Every match is a protected entity. The corpus tells how strongly a term reveals one: with n_e and
n_t the numbers of documents that hold the entity and the term and n_et those where the term
stands near the entity, of n documents, the term has the pointwise mutual information
log(n_et n / (n_e n_t)) with the entity, out of the entity's information content log(n / n_e). A
term that stands near an entity in SUPPORT different texts or more and has at least GENERALISE of
its content is generalised wherever it occurs; one with at least REMOVE is removed.

Defined results: a null text is empty. Spans are in code points, end exclusive. Base spans of one
kind are leftmost and do not overlap; those that fail their check are dropped and not tried again.
Base spans stay whatever else is found. Rows that repeat count as often as they stand, but as one
text. Other columns are not read by the statistics and are kept by sanitise().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, plain, text_of, written

#: Kinds and their patterns. Possessive quantifiers and the conditions before a match keep the
#: leftmost matches of the plain patterns without trying each place of a long run again.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
_TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

SUPPORT, GENERALISE, REMOVE = 2, 0.9, 0.98
#: Terms up to which they are looked up within a row.
INLINE_TERMS = 10_000
#: Code points before and after an entity that are searched for terms.
REACH = 80
_TERM = r"\p{L}{4,}"
_SPANS = "array<struct<kind: string, start: int, end: int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Valid spans of one kind: matches and the gaps between them give the places."""
    pattern = PATTERNS[kind]
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"cast(array() as {_SPANS})")

    def walk(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(_valid(kind, pair["match"]), F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), walk, lambda s: s["spans"])
    trigger = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_TRIGGER[kind])
    return F.when(trigger, spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """All valid matches, by kind as listed, then by start."""
    return F.concat(*[_found(text, kind) for kind in PATTERNS])


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _key(text: Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _sent(terms: DataFrame) -> DataFrame:
    """A written table of terms, to be sent to every executor only if it is small."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0]
    return F.broadcast(terms) if (size or 0) <= BROADCAST_BYTES else terms


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, action): terms whose co-occurrence in all of docs gives some entity away."""
    texts = docs.select(text_of(text_col).alias("text")).select("text", _key(F.col("text")).alias("doc"), F.monotonically_increasing_id().alias("row"))
    spans = texts.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0).select("text", "doc", "row", F.explode("spans").alias("s"))
    entity = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    key = F.concat_ws(":", "s.kind", F.when(F.col("s.kind") == "email", F.lower(entity)).when(F.col("s.kind") == "ip", entity).otherwise(_digits(entity)))
    first = F.greatest(F.col("s.start") - REACH, F.lit(0))
    before = F.substring(F.col("text"), first + 1, F.col("s.start") - first)
    before = F.when(first > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.regexp_replace(F.substring(F.col("text"), F.col("s.end") + 1, F.lit(REACH)), r"\p{L}+$", "")
    near = written(spans.select(key.alias("entity"), "doc", "row", _words(F.concat(before, F.lit(" "), after)).alias("terms")), "pii-near")
    pairs = near.select("entity", "doc", "row", F.explode("terms").alias("term")).distinct().groupBy("entity", "term")
    pairs = written(pairs.agg(F.count("*").alias("n_et"), F.countDistinct("doc").alias("texts")).where(f"texts >= {support}"), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("term", F.lit("").alias("action"))
    entities = near.select(F.col("entity").alias("e"), "row").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    around = near.select("row", F.explode("terms").alias("a")).distinct().groupBy("a").agg(F.count("*").alias("n_near"))
    n = docs.count()
    content = F.log(F.lit(n) / F.col("n_e"))

    def share(n_t: str) -> Column:
        return F.when(content > 0, F.log(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.col(n_t))) / content).otherwise(0.0)

    # A term stands in as many documents at least as it does near entities, which bounds its share. Only
    # the terms that this leaves are counted: they meet the words before these are grouped.
    open_ = pairs.join(entities, F.col("entity") == F.col("e")).join(around, F.col("term") == F.col("a")).where(share("n_near") >= generalise)
    open_ = written(open_.select("term", "n_et", "n_e", "n_near"), "pii-open")
    wanted = written(open_.select("term").distinct(), "pii-wanted")
    words = texts.select(F.explode(_words(F.col("text"))).alias("t"))
    counts = written(words.join(_sent(wanted), F.col("t") == F.col("term"), "left_semi").groupBy("t").agg(F.count("*").alias("n_t")), "pii-counts")
    shares = open_.join(counts, F.col("term") == F.col("t")).withColumn("share", F.least(share("n_t"), share("n_near")))
    strongest = shares.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise)
    return written(strongest.select("term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")), "pii-terms")


def _term_spans(text: Column, action_of: Callable[[Column], Column]) -> Column:
    """Spans of whole words that have an action."""
    matches = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    none = F.expr(f"cast(array() as {_SPANS})")

    def walk(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        action = action_of(F.lower(pair["match"]))
        span = F.struct(F.concat(F.lit("term-"), action).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(action.isNotNull(), F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(F.split(text, _TERM, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), walk, lambda s: s["spans"])


def find_pii(docs: DataFrame, text_col: str = "text", base_col: str = "pii_base", spans_col: str = "pii_spans", inline_terms: int = INLINE_TERMS, **thresholds) -> DataFrame:
    """docs with their base spans and with all spans, those of disclosing terms after the base.

    Up to `inline_terms` terms are looked up in a set within each row; more meet the words of each
    different text in a join, and the texts that hold some meet these by their hash.
    """
    own, (name,) = plain(docs, text_col)
    text = text_of(name)
    terms = disclosing_terms(own, name, **thresholds)
    found = own.withColumn("base", base_spans(text))
    some = terms.limit(inline_terms + 1).collect()
    if not some:
        found = found.withColumn("spans", F.col("base"))
    elif len(some) <= inline_terms:
        by = {action: [r.term for r in some if r.action == action] for action in ("remove", "generalise")}

        def action_of(word: Column) -> Column:
            action = F.lit(None).cast("string")
            for name, words in by.items():
                action = F.when(word.isin(words), F.lit(name)).otherwise(action) if words else action
            return action

        holds = F.exists(_words(text), lambda w: w.isin([r.term for r in some]))
        found = found.withColumn("spans", F.concat("base", F.when(holds, _term_spans(text, action_of)).otherwise(F.expr(f"cast(array() as {_SPANS})"))))
    else:
        words = own.select(_key(text).alias("doc"), F.explode(_words(text)).alias("word"))
        held = words.join(_sent(terms), F.col("word") == F.col("term")).groupBy("doc").agg(F.collect_set(F.struct("term", "action")).alias("held"))
        held = written(held.select("doc", F.map_from_entries("held").alias("held")), "pii-held")
        joined = found.withColumn("key", _key(text)).join(held, F.col("key") == F.col("doc"), "left")
        more = F.when(F.col("held").isNotNull(), _term_spans(text, lambda w: F.element_at("held", w))).otherwise(F.expr(f"cast(array() as {_SPANS})"))
        found = joined.withColumn("spans", F.concat("base", more))
    return found.select(*own.columns, "base", "spans").toDF(*docs.columns, base_col, spans_col)


def span_list(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """docs with each span of text_col replaced: [email] and the like, [term], or nothing.

    Of spans that overlap, the first and of those the longest is replaced.
    """
    own, (name,) = plain(docs, text_col)
    found = find_pii(own, name, "base", "spans", **thresholds)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    text = text_of(name)

    def walk(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term-remove", "").when(s["kind"] == "term-generalise", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        new = F.struct((-s["end"]).alias("at"), F.array_append(state["parts"], F.concat(kept, mark)).alias("parts"))
        return F.when(s["start"] >= state["at"], new).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    whole = F.aggregate(order, start, walk, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return found.select(*[c if c != name else F.when(F.col(name).isNotNull(), whole).alias(name) for c in own.columns]).toDF(*docs.columns)
