"""Information-theoretic sanitisation of personal data, in DataFrame and SQL functions only.

Four patterns find the protected entities (e-mail, ip, card, phone). Around every occurrence, the whole words of its line
within ``WINDOW`` characters are its context. Over the whole corpus, a term t discloses an entity e by

    P(e | t) = documents with t in a context of e / documents with t
    P(e) = documents with e / documents        bits = log2(P(e | t) / P(e))

Copies count as documents here, but a term also needs ``MIN_CONTEXTS`` different contexts of one entity, to which copies add
nothing. A term that reaches ``GENERALISE`` and ``MIN_BITS`` is generalised wherever it occurs; one that reaches ``REMOVE``
is removed.

Positions come from two native functions over the same pattern: split() gives what lies between the matches and
regexp_extract_all() the matches, so a match starts after the lengths of all that came before. Quantifiers are
possessive and runs are entered only at their start (or where the last match ended), which matches the same
substrings as the plain patterns but takes linear time and constant stack on any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import broadcast_if_small, materialize

#: The kinds in their order, with the patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = "term"
#: Characters on either side of an entity that are its context.
WINDOW = 120
#: Different contexts of one entity that a term needs.
MIN_CONTEXTS = 3
#: Disclosure thresholds: P(entity | term) and bits.
GENERALISE, REMOVE, MIN_BITS = 0.5, 0.9, 3.0
#: Texts with terms up to which their spans are broadcast.
TEXT_ROWS = 20_000
#: What a term is made of; it holds two of these and a letter at least.
TERM_LETTERS = r"[\p{L}\p{N}]"


def _luhn(digits: str) -> str:
    """SQL: whether the string of digits passes Luhn."""
    doubled = "cast(substring(z, i, 1) as int) * if(i % 2 = 0, 2, 1)"
    total = f"aggregate(transform(sequence(1, length(z)), i -> {doubled}), 0, (s, x) -> s + if(x > 9, x - 9, x))"
    return f"exists(array(reverse({digits})), z -> {total} % 10 = 0)"


def valid_sql(kind: str, v: str) -> str:
    """SQL: whether a match stands."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return f"regexp_like({v}, r'^{part}(?:\\.{part}){{3}}$')"
    if kind == "card":
        return f"(length({digits}) between 14 and 19 and {_luhn(digits)})"
    return f"length({digits}) between 10 and 15"


def spans(text: str, kind: str, pattern: str, valid: str = "true", when: str = "true") -> Column:
    """Array of (start, rank, end, kind, value) for the matches of ``pattern`` that are ``valid`` (SQL over v).

    All arguments but ``kind`` are SQL; ``when`` says cheaply which texts can match at all.
    """
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    made = f"named_struct('start', 0, 'rank', {rank}, 'end', 0, 'kind', '{kind}', 'value', '')"
    found = f"""
      transform(array(named_struct('gaps', transform(split({text}, {pattern}, -1), g -> length(g)), 'hits', regexp_extract_all({text}, {pattern}, 0))), x ->
        transform(
          filter(transform(x.hits, (v, i) -> if({valid}, i, null)), i -> i is not null),
          i -> transform(array(
            aggregate(slice(x.gaps, 1, i + 1), 0, (s, n) -> s + n) + aggregate(slice(x.hits, 1, i), 0, (s, v) -> s + length(v))),
            at -> named_struct('start', at, 'rank', {rank}, 'end', at + length(x.hits[i]), 'kind', '{kind}', 'value', x.hits[i]))[0]))[0]"""
    return F.expr(f"if({when}, {found}, slice(array({made}), 1, 0))")


def base_spans(text: str) -> Column:
    """All base spans of a text, by start, then kind as listed."""

    def of(kind: str) -> Column:
        pattern = f"r'{PATTERNS[kind]}'"
        return spans(text, kind, pattern, valid_sql(kind, "v"), f"contains({text}, '{NEEDED[kind]}') and regexp_like({text}, {pattern})")

    return F.array_sort(F.concat(*map(of, KINDS)))


def joined(of: str) -> Column:
    return F.array_join(F.expr(f"transform({of}, s -> concat(s.kind, ':', s.start, ':', s.end))"), ",")


def words_of(text: str) -> Column:
    """The different runs of letters and digits of a text, lower-cased; the terms are among them."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]++"))


def is_term(word: str) -> Column:
    return (F.length(word) >= 2) & F.col(word).rlike(r"\p{L}")


def contexts(text: str, of: str) -> Column:
    """Array of (entity, context) for an array of spans. Words that the window cuts, or that touch the entity, are left out."""
    before = f"substring({text}, greatest(1, s.start - {WINDOW}), least(s.start, {WINDOW + 1}))"
    before = f"regexp_replace(if(s.start > {WINDOW}, regexp_replace({before}, r'^{TERM_LETTERS}+', ''), {before}), r'(?<!{TERM_LETTERS}){TERM_LETTERS}++$', '')"
    after = f"substring({text}, s.end + 1, {WINDOW + 1})"
    after = f"regexp_replace(if(length({after}) > {WINDOW}, regexp_replace({after}, r'(?<!{TERM_LETTERS}){TERM_LETTERS}++$', ''), {after}), r'^{TERM_LETTERS}+', '')"
    lines = f"lower(concat(substring_index({before}, '\n', -1), ' ', substring_index({after}, '\n', 1)))"
    return F.expr(f"transform({of}, s -> named_struct('entity', xxhash64(s.kind, lower(s.value)), 'context', {lines}))")


def disclosing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, action) from ``found`` (digest, contexts: array of (entity, context)), a row for each row of ``docs`` (text).
    All counts are of documents; copies are counted once with their number."""
    each = found.where("size(contexts) > 0").select("digest", F.explode(F.array_distinct("contexts")).alias("c"))
    around = materialize(each.groupBy("digest", "c.entity", "c.context").agg(F.count(F.lit(1)).alias("copies")))
    words = around.select("digest", "entity", "copies", F.xxhash64("context").alias("context"), F.explode(words_of("context")).alias("term")).where(is_term("term"))
    several = words.groupBy("term", "entity").agg(F.count_distinct("context").alias("n_contexts")).where(F.col("n_contexts") >= MIN_CONTEXTS)
    several = materialize(several.drop("n_contexts"))
    chosen = broadcast_if_small(several)
    once = words.join(chosen, ["term", "entity"]).groupBy("term", "entity", "digest").agg(F.max("copies").alias("copies"))
    together = once.groupBy("term", "entity").agg(F.sum("copies").alias("n_te"))
    entities = around.join(chosen.select("entity"), "entity", "left_semi").groupBy("entity", "digest").agg(F.max("copies").alias("copies"))
    entities = entities.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    # words are counted before they meet the terms: a row for each word, not for each text that holds one
    counts = docs.select(F.explode(words_of("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = found.count()
    return (
        together.join(entities, "entity")
        .join(counts, "term")
        .withColumn("p", F.col("n_te") / F.col("n_t"))
        .withColumn("bits", F.log2(F.col("p") * F.lit(float(n)) / F.col("n_e")))
        .where((F.col("p") >= GENERALISE) & (F.col("bits") >= MIN_BITS))
        .groupBy("term")
        .agg(F.when(F.max("p") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, base, spans, actions): one row per row of ``docs``.

    ``base`` are the spans of the four patterns, ``spans`` these and the disclosing terms, both arrays of (start, rank,
    end, kind, value) by start, then kind as listed, in code points with the end exclusive; ``actions`` says for each
    term of the text what becomes of it. A null text is an empty one: no spans. Texts are read whole; equal texts, and
    repeated rows, have equal spans. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    base = materialize(keyed.withColumn("base", base_spans("text")).select("id", "digest", "base", contexts("text", "base").alias("contexts")))
    terms = materialize(disclosing_terms(base, texts))
    # the terms of each text: most texts have none; of copies only the row with the smallest id is searched
    listed = materialize(
        keyed.select("id", "digest", F.explode(words_of("text")).alias("term"))
        .join(broadcast_if_small(terms), "term")
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.array_sort(F.collect_set(F.struct("term", "action"))).alias("actions"))
    )
    pattern = rf"concat('(?iu)(?<!{TERM_LETTERS})(?:', array_join(transform(actions, a -> a.term), '|'), ')(?!{TERM_LETTERS})')".replace("\\", "\\\\")
    once = keyed.join(broadcast_if_small(listed, TEXT_ROWS).withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("first")))
    placed = materialize(once.select("digest", spans("text", TERM, pattern).alias("added"), "actions").dropDuplicates(["digest"]))
    none = F.slice(F.col("base"), 1, 0)
    return base.join(broadcast_if_small(placed, TEXT_ROWS), "digest", "left").select(
        "id", "digest", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"), "actions"
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text column: base spans by [KIND], generalised terms by [TERM], removed
    terms by nothing; of overlapping spans the first gives the label and all are covered. Rows as in ``docs``."""
    found = find_personal_data(docs, id_col, text_col).select("digest", "spans", "actions").where("size(spans) > 0").dropDuplicates(["digest"])
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    label = (
        "case when s.kind <> 'term' then concat('[', upper(s.kind), ']') "
        "when exists(actions, a -> a.term = lower(s.value) and a.action = 'remove') then '' else '[TERM]' end"
    )
    out = F.expr(
        f"""transform(array(aggregate(spans, named_struct('out', '', 'at', 0), (a, s) ->
          if(s.start < a.at, named_struct('out', a.out, 'at', greatest(a.at, s.end)),
             named_struct('out', concat(a.out, substring(t, a.at + 1, s.start - a.at), {label}), 'at', s.end)))),
          a -> concat(a.out, substring(t, a.at + 1)))[0]"""
    )
    rows = keyed.join(found, F.unhex(F.sha2("t", 256)) == F.col("digest"), "left")
    clean = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(out)
    return rows.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
