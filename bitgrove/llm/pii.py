"""Personal data: base spans by pattern, then information-theoretic sanitisation of revealing terms.

Protected entities are the values of the base spans. A term t reveals an entity e as far as the corpus says so: with
p(.) as shares of all documents and p(t|e) as the share of e's texts that have t anywhere, log2(p(t|e) / p(t)) over the
entity's own information -log2 p(e) is the share of the entity that the term discloses (1: whoever reads the term
knows the entity; 0: they are independent). Terms at or above REMOVE are removed, those at or above GENERALISE are
replaced by their class, wherever they stand.

A text speaks for an entity as a whole: all of its words count, wherever the entity stands and however often. Two rules keep
chance out. Copies of one passage (PASSAGE characters on either side) are one testimony, not many: texts in which any two passages
of the entity share half of their runs of three words or more are joined (min-hashes in bands, then labels passed along), and so
are, for a term that passes, texts in which passages of the term do; a pair of entity and term needs MIN_CONTEXTS testimonies. And
the pair must be beyond chance: were t strewn over the texts, the probability of meeting it in so many of e's testimonies
(Chernoff's bound) must stay below CHANCE for all pairs tested together.

Only DataFrame functions. Pass one finds base spans; entities of MIN_CONTEXTS texts or more are known. Pass two
takes the passages of the known from the documents that hold them, pass three the words of the texts of those with testimonies
enough; what is counted is pairs of entity and term, a row for each task. Pass four counts the documents that hold each candidate
term, pass five takes the passages of the terms that pass, pass six places the terms that disclose; bitmaps of bounded size pick
the rows and words of each pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lower_ascii, materialise, table
from .exact_dedup import bits_for, in_bitmap, keys_bitmap

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the corpus adds: terms to be generalised, and terms to be removed.
TERM_KINDS = ("term", "removed")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# What the four kinds look like. Possessive repeats and the anchors change no match; they keep
# long runs of letters or digits from being tried again from each of their characters.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: Characters on either side of an entity or term that make its passage; testimonies that a pair must have.
PASSAGE, MIN_CONTEXTS = 300, 3
#: Words of a run; bands of min-hashes and min-hashes of a band: passages that share half of their runs meet in a band with a
#: probability of 0.986, those that share a fifth with 0.23, a tenth with 0.03. Rounds in which labels are passed on.
RUN, BANDS, ROWS, ROUNDS = 3, 32, 3, 3
#: Shares of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.4, 0.6
#: Probability, over all pairs tested, that any of them passes by chance.
CHANCE = 0.01
#: What a term looks like: a run of three letters or more.
TERM = r"\p{L}{3,}+"
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)


def sums_before(numbers: Column) -> Column:
    """For each element of an int array the sum of those before it. Two levels: O(n) sums of at most a block, and n/64 of blocks."""

    def with_blocks(n: Column) -> Column:
        count = F.ceil(F.size(n) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = let(blocks, lambda s: F.transform(s, lambda _, i: _sum(F.slice(s, F.lit(1), i))))
        return let(before, lambda s: F.transform(n, lambda _, i: F.element_at(s, (F.floor(i / _BLOCK) + 1).cast("int")) + _sum(F.slice(n, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return F.when(F.size(numbers) > 0, let(numbers, with_blocks)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<value, start>> of the leftmost non-overlapping matches; start in code points."""

    def place(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        gaps = F.transform(pieces, lambda p: F.length(p))
        both = let(gaps, lambda g: let(sums_before(F.zip_with(F.slice(g, F.lit(1), F.size(found)), found, lambda a, m: a + F.length(m))), lambda s: F.transform(found, lambda m, i: F.struct(m.alias("value"), (F.element_at(s, i + 1) + F.element_at(g, i + 1)).alias("start")))))
        return F.when(F.size(found) > 0, both).otherwise(F.array().cast("array<struct<value:string,start:int>>"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check: from the right, every second digit doubled, 9 off where that passes 9."""

    def digit(d: Column, i: Column) -> Column:
        n = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, n * 2).otherwise(n)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return let(digits, lambda d: _sum(F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: digit(d, i))) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """A cheap necessary condition for a match."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, value>> of all base spans in order of start, then kind."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")

    def of(rank: int, kind: str) -> Column:
        own = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: _valid(kind, m["value"]))
        return F.when(_hint(kind, text), _spans(own, lambda m: F.lit(rank))).otherwise(empty)

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _spans(found: Column, rank: Callable[[Column], Column]) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), rank(m).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))


def joined(spans: Column, names: tuple[str, ...] = (*KINDS, *TERM_KINDS)) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_words(text: Column) -> Column:
    """Words of three letters or more, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def entity_of(span: Column) -> Column:
    return F.concat_ws(":", span["rank"].cast("string"), F.lower(span["value"]))


def beside(text: Column, start: Column, end: Column) -> Column:
    """array<string>: the words of the passage of a span, lower-cased, a bar where the span stands.
    Tokens with digits or @ and words cut at the passage's ends are left out."""
    left = F.substring(text, F.greatest(start - PASSAGE + 1, F.lit(1)), F.least(start, F.lit(PASSAGE)))
    right = F.substring(text, end + 1, F.lit(PASSAGE))
    whole_left = F.when(start > PASSAGE, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    whole_right = F.when(F.length(right) == PASSAGE, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return F.concat(tokens(whole_left), F.array(F.lit("|")), tokens(whole_right))


def tokens(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"\s+"), lambda w: w.rlike(r"^[^@0-9]+$"))


def passages(text: Column, spans: Column) -> Column:
    """array<struct<entity, tokens>>: the unlike passages of each entity among the spans."""
    return F.array_distinct(F.transform(spans, lambda s: F.struct(entity_of(s).alias("entity"), beside(text, s["start"], s["end"]).alias("tokens"))))


def bands(tokens: Column) -> Column:
    """array<bigint>: a hash of each band of min-hashes over the runs of RUN tokens; fewer tokens are one run."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - RUN + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, F.lit(RUN)), " ")))
    least = let(runs, lambda h: F.transform(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda k: F.array_min(F.transform(h, lambda x: F.xxhash64(x, k)))))
    return let(least, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(m, b * ROWS + 1, F.lit(ROWS)))))


def testimonies(own: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """(id, label) of rows (id, entity, tokens), ids: longs, one row or more for each: those of one entity with tokens that are near
    copies get one label. alike: (id, _k), ids with an equal _k get one label too."""
    shared = own.select("id", "entity", F.explode(bands(F.col("tokens"))).alias("_b")).select("id", F.xxhash64("entity", "_b").alias("_k"))
    shared = materialise(shared if alike is None else shared.unionAll(alike), "bands", narrow=True)
    labels = own.select("id", F.col("id").alias("label")).distinct()
    for _ in range(ROUNDS):
        least = shared.join(labels, "id").groupBy("_k").agg(F.min("label").alias("label"))
        labels = materialise(shared.join(least, "_k").groupBy("id").agg(F.min("label").alias("label")), "testimonies", narrow=True)
    return labels


def disclosing_terms(docs: DataFrame, based: DataFrame) -> DataFrame:
    """(term, share): the terms that disclose some entity by GENERALISE or more. docs: (_id, _t); based: (_x, _b) with the base spans of each."""
    held = based.where(F.size("_b") > 0).select("_x", F.explode(F.array_distinct(F.transform("_b", entity_of))).alias("entity"))
    held = materialise(held.groupBy("entity", "_x").agg(F.count(F.lit(1)).alias("n")), "held", narrow=True)
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= MIN_CONTEXTS)
    entities = materialise(entities, "entities", narrow=True)
    bits = bits_for(entities.count())
    known = keys_bitmap(entities.select("entity"), "entity", bits=bits)
    having = held.where(in_bitmap(known, F.col("entity"), bits=bits)).select("_x")
    wide = bits_for(having.count())
    holders = keys_bitmap(having.distinct(), "_x", bits=wide)
    asked = docs.select(F.xxhash64("_t").alias("_x"), "_t").where(in_bitmap(holders, F.col("_x"), bits=wide))
    found = asked.select("_x", F.explode(passages(F.col("_t"), base_spans(F.col("_t")))).alias("p")).where(in_bitmap(known, F.col("p.entity"), bits=bits))
    # every unlike passage of an entity in a text
    own = found.select(F.xxhash64("p.entity", "_x").alias("id"), F.col("p.entity").alias("entity"), "_x", F.col("p.tokens").alias("tokens")).distinct()
    own = materialise(own, "passages")
    told = own.select("id", "entity", "_x").distinct().join(testimonies(own), "id")
    apart = told.groupBy("entity").agg(F.countDistinct("label").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS)
    apart = materialise(apart, "apart", narrow=True)
    told = materialise(told.join(apart.select("entity"), "entity", "left_semi"), "told", narrow=True)
    several = keys_bitmap(told.select("_x").distinct(), "_x")
    # all words of the whole texts of these
    speaking = asked.where(in_bitmap(several, F.col("_x")))
    heard = speaking.select("_x", F.explode(F.array_distinct(term_words(F.array_join(tokens(F.col("_t")), " ")))).alias("term")).join(told.select("_x", "entity", "label"), "_x")
    pairs = heard.groupBy("entity", "term").agg(F.countDistinct("label").alias("n_both")).where(F.col("n_both") >= MIN_CONTEXTS)
    pairs = materialise(pairs, "pairs", narrow=True)
    bitmap = keys_bitmap(pairs.select(F.col("term").alias("_k")).distinct(), "_k")
    words = docs.select(F.explode(F.array_distinct(term_words(F.col("_t")))).alias("term")).where(in_bitmap(bitmap, F.col("term")))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total, tested = docs.agg(F.count(F.lit(1)).cast("double")).scalar(), pairs.agg(F.count(F.lit(1)).cast("double")).scalar()
    known_pairs = pairs.join(entities.select("entity", "n_entity"), "entity").join(apart, "entity").join(counts, "term").where(F.col("n_entity") < total)

    def sure(joined: DataFrame) -> DataFrame:
        given = F.col("n_both") / F.col("contexts")
        base = F.greatest(F.col("n_term"), given * F.col("n_entity")) / total
        scored = joined.withColumns({"given": given, "base": base, "share": F.log2(given / base) / F.log2(total / F.col("n_entity"))})
        missed = 1 - F.col("given")
        information = F.col("given") * F.log(F.col("given") / F.col("base")) + F.when(missed > 0, missed * F.log(missed / F.greatest(1 - F.col("base"), F.lit(1e-12)))).otherwise(F.lit(0.0))
        return scored.where((F.col("given") > F.col("base")) & (F.col("contexts") * information >= F.log(tested / F.lit(CHANCE))) & (F.col("share") >= GENERALISE))

    likely = materialise(sure(known_pairs).drop("given", "base", "share"), "likely", narrow=True)
    # what was copied far from the entity is one testimony as well: passages of the likely terms
    chosen = keys_bitmap(likely.select(F.col("term").alias("_k")).distinct(), "_k")
    placed = speaking.select("_x", "_t", F.explode(matches(lower_ascii(F.col("_t")), F.lit(TERM))).alias("m")).where(in_bitmap(chosen, F.col("m.value")))
    around = placed.select("_x", F.col("m.value").alias("term"), beside(F.col("_t"), F.col("m.start"), F.col("m.start") + F.length("m.value")).alias("tokens")).distinct()
    mine = around.join(told.select("_x", "entity", "label"), "_x").join(likely.select("entity", "term"), ["entity", "term"], "left_semi")
    mine = mine.select(F.xxhash64("entity", "term", "_x").alias("id"), F.struct("entity", "term").alias("entity"), "label", "tokens")
    mine = materialise(mine, "term-passages")
    alike = mine.select("id", F.xxhash64("entity", "label", F.lit(0)).alias("_k")).distinct()
    apart_too = mine.select("id", "entity").distinct().join(testimonies(mine.select("id", "entity", "tokens"), alike), "id")
    n_both = apart_too.groupBy("entity").agg(F.countDistinct("label").alias("n_both")).where(F.col("n_both") >= MIN_CONTEXTS).select("entity.entity", "entity.term", "n_both")
    last = sure(likely.drop("n_both").join(n_both, ["entity", "term"]))
    return materialise(last.groupBy("term").agg(F.max("share").alias("share")), "terms", narrow=True)


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, _x, _ts): spans of the terms in each document that holds one; _x: a hash of the text.

    Words are placed where the text is read; what is shuffled is a few numbers for each place of a term, never a text.
    """
    bitmap = keys_bitmap(terms.select(F.col("term").alias("_k")), "_k")
    words = docs.select(F.xxhash64("_t").alias("_x"), F.explode(F.array_distinct(term_words(F.col("_t")))).alias("term"))
    holders = keys_bitmap(words.where(in_bitmap(bitmap, F.col("term"))).select("_x").distinct(), "_x")
    texts = docs.select("_id", F.xxhash64("_t").alias("_x"), "_t").where(in_bitmap(holders, F.col("_x")))
    placed = texts.select("_id", "_x", F.explode(matches(lower_ascii(F.col("_t")), F.lit(TERM))).alias("m")).where(in_bitmap(bitmap, F.col("m.value")))
    sure = placed.select("_id", "_x", F.col("m.start").alias("start"), F.col("m.value").alias("value")).join(terms, F.col("value") == F.col("term"))
    span = F.struct("start", F.when(F.col("share") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS)).alias("rank"), (F.col("start") + F.length("value")).alias("end"), "value")
    return sure.groupBy("_id", "_x").agg(F.collect_set(span).alias("_ts"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) per row of docs: arrays of struct<start, rank, end, value>, ordered by start, then rank.

    rank numbers KINDS, then TERM_KINDS; positions are code points, end exclusive. base are the spans by pattern, spans
    those and the revealing terms that don't overlap a base span. Null text counts as empty; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    based = materialise(rows.select("_id", F.xxhash64("_t").alias("_x"), base_spans(F.col("_t")).alias("_b")), "base")
    terms = disclosing_terms(rows, based.select("_x", "_b"))
    placed = _term_spans(rows, terms).select(F.col("_id").alias("_pi"), F.col("_x").alias("_px"), "_ts")
    both = based.join(placed, (F.col("_x") == F.col("_px")) & F.col("_id").eqNullSafe(F.col("_pi")), "left")
    free = F.filter("_ts", lambda t: ~F.exists("_b", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    every = F.when(F.col("_ts").isNull(), F.col("_b")).otherwise(F.array_sort(F.concat("_b", free)))
    return both.select(F.col("_id").alias(id_col), F.col("_b").alias("base"), every.alias("spans"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))


    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sanitised: string): base spans become [KIND], generalised terms [TERM], and removed ones go. Ids must be unique."""
    found = find(docs, id_col, text_col).select(F.col(id_col).alias("_i"), "spans")
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(found, F.col(id_col) == F.col("_i"))
    names = F.array(*(F.lit("" if k == "removed" else f"[{k.upper()}]") for k in (*KINDS, *TERM_KINDS)))

    def step(acc: Column, s: Column) -> Column:
        kept = F.when(s["start"] > acc["at"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        mark = F.when(s["start"] >= acc["at"], F.element_at(names, s["rank"] + 1)).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], kept, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    return rows.select(id_col, done.alias("sanitised"))
