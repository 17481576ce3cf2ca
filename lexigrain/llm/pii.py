"""Personal data: base patterns, and information-theoretic sanitisation around them (DataFrame functions only).

Base spans are the leftmost matches of four patterns.  The patterns used here match the same spans as the plain
ones below, but neither recurse nor start again inside a run, so that one long text takes linear time.

Sanitisation: the terms around an entity, up to CONTEXT characters on either side and across lines, may give the
entity away.  Over all N documents, with frequencies that count documents, for entity e and term t

    PMI(t, e) = log2(N * df(t, e) / ((df(t) + UNSEEN) * df(e))),    IC(e) = log2(N / df(e))

and a term discloses the share PMI / IC of the entity's information.  Terms that reach GENERALISE are generalised,
and from REMOVE on removed, wherever they stand in a document in which they are beside the entity.  df(t, e) counts
the documents where t stands around e.  Pairs of a single document are scored like all others: each term is taken to
be in UNSEEN more documents without the entity, so one document proves less where the corpus is small.  Copies count
as documents, which lowers PMI and IC alike.

Defined cases: a null text is empty; texts without spans give zeros and the digest of the empty list; repeated rows
each have their own spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, table

#: The kinds and their plain patterns, in the order in which they are reported.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "generalise", "remove"]
GENERALISE, REMOVE, UNSEEN = 0.5, 0.8, 1
#: Characters before and after an entity, up to the next one of its kind, whose terms are held against it.
CONTEXT = 500
TERM = r"\p{L}{3,}"
#: Stands for a separator inside a card number or a dot inside a host name; in the text itself it becomes OTHER,
#: which no pattern takes either.
JOINT, OTHER = "\ue000", "\ue001"


def _joined(text: Column, around: str, separator: str) -> Column:
    """Single separators between two characters of ``around`` become JOINT; places stay as they are."""
    return F.regexp_replace(F.translate(text, JOINT, OTHER), f"(?<={around}){separator}(?={around})", JOINT)


def _sought(text: Column) -> dict[str, tuple[Column, Column, str]]:
    """By kind: whether a text may have it, the text to search, and the pattern."""
    return {
        "email": (F.contains(text, F.lit("@")), _joined(text, "[A-Za-z0-9-]", r"\."), rf"(?:(?<![A-Za-z0-9._%+{JOINT}-])|\G)[A-Za-z0-9._%+{JOINT}-]+@[A-Za-z0-9-]+{JOINT}[A-Za-z0-9{JOINT}-]+"),
        "ip": (F.rlike(text, F.lit(r"[0-9]\.[0-9]")), text, r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        "card": (F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){11}")), _joined(text, "[0-9]", "[ -]"), f"[0-9][0-9{JOINT}]+"),
        "phone": (F.contains(text, F.lit("+")), text, PATTERNS["phone"]),
    }


def _cut(text: Column, pattern: str, may: Column) -> Column:
    """Matches with the gap before each and the text around it, by one pass of the same matcher; words that the context cuts are left out."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("after"))
    before = lambda gap: F.when(F.length(gap) > CONTEXT, F.regexp_replace(F.right(gap, F.lit(CONTEXT)), r"^\p{L}+", "")).otherwise(gap)
    after = lambda gap: F.when(F.length(gap) > CONTEXT, F.regexp_replace(F.left(gap, F.lit(CONTEXT)), r"\p{L}+$", "")).otherwise(gap)
    found = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), F.length(x["gap"]).alias("gap"), x["value"].alias("value"), before(x["gap"]).alias("left"), after(x["after"]).alias("right")))
    found = F.filter(found, lambda x: x["value"].isNotNull())
    return F.when(may, found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the check sum."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    at = lambda i: F.substring(F.rpad(F.reverse(digits), 19, "0"), i, 1).cast("int")
    sums = [at(i) if i % 2 else doubled(at(i)) for i in range(1, 20)]
    return sum(sums[1:], sums[0]) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits, n = _digits(value), F.length(_digits(value))
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    octets = F.forall(F.split(value, r"\."), lambda p: F.when(part(p), F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255).otherwise(False))
    return (kind == "email") | F.when(kind == "ip", octets).when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(False)


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row, and the text where it may have spans), and their base spans with contexts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    cuts = {kind: _cut(t, pattern, may) for kind, (may, t, pattern) in _sought(F.col("text")).items()}
    none = [F.coalesce(F.size(F.col(k)), F.lit(0)) == 0 for k in cuts]
    clean = none[0] & none[1] & none[2] & none[3]
    read = base.select("doc_id", "row", "text", *(c.alias(k) for k, c in cuts.items()))
    read = table(read.withColumn("text", F.when(~clean, F.col("text"))), compression="zstd")
    tag = lambda kind: F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("m")))
    nothing = F.array().cast("array<struct<kind:string,m:struct<pos:int,gap:int,value:string,left:string,right:string>>>")
    found = read.where("text IS NOT NULL").select("row", F.explode(F.concat(*(F.coalesce(tag(k), nothing) for k in cuts))).alias("f"))
    found = found.select("row", "f.kind", "f.m.*")
    w = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return read.select("doc_id", "row", "text"), found.where(_valid(F.col("kind"), F.col("value"))).drop("gap", "pos")


def _terms(context: Column) -> Column:
    return F.regexp_extract_all(context, F.lit(TERM), F.lit(0))


def term_pairs(mentions: DataFrame) -> DataFrame:
    """(row, kind, value, term), once each: the terms around the entities of a document."""
    words = F.array_distinct(F.concat(_terms(F.lower("left")), _terms(F.lower("right"))))
    return mentions.select("row", "kind", "value", F.explode(words).alias("term")).distinct()


def disclosing_terms(docs: DataFrame, pairs: DataFrame, n_docs: int, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, unseen: int = UNSEEN) -> DataFrame:
    """(kind, value, term, action, share) for the terms that reach the threshold, over all of ``docs``.

    Terms of all documents are counted before they are shuffled, so a task sends each of its terms once.  Joins are of
    written tables, which Spark broadcasts where their files are small.
    """
    together = table(pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("df_te")))
    terms = table(together.select("term").distinct())
    seen = docs.select(F.explode(F.array_distinct(_terms(F.lower(F.coalesce(F.col(text_col), F.lit("")))))).alias("term"))
    counts = table(seen.groupBy("term").agg(F.count("*").alias("df_t")).join(terms, "term", "left_semi"))
    entities = pairs.select("row", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("*").alias("df_e"))
    scored = together.join(table(entities), ["kind", "value"]).join(counts, "term")
    pmi = F.log2(F.lit(float(n_docs)) * F.col("df_te") / ((F.col("df_t") + unseen) * F.col("df_e")))
    ic = F.log2(F.lit(float(n_docs)) / F.col("df_e"))
    scored = scored.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0)).where(F.col("share") >= generalise)
    return scored.select("kind", "value", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"), "share")


def _occurrences(texts: DataFrame) -> DataFrame:
    """Every term of (row, text): row, term (lower case), start, end."""
    gaps = F.arrays_zip(_terms(F.col("text")).alias("word"), F.split("text", TERM, -1).alias("gap"))
    rows = texts.select("row", F.posexplode(gaps).alias("pos", "g")).select("row", "pos", F.col("g.word").alias("word"), F.length("g.gap").alias("gap"))
    w = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("word IS NOT NULL").withColumn("end", F.sum(F.col("gap") + F.length("word")).over(w))
    return rows.select("row", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and all spans: row, kind, start, end."""
    everything, mentions = _mentions(docs, id_col, text_col)
    mentions = table(mentions, compression="zstd")
    pairs = table(term_pairs(mentions))
    terms = table(disclosing_terms(docs, pairs, everything.count(), text_col))
    # A term may stand beside several entities; the stricter action holds.
    judged = pairs.join(terms, ["kind", "value", "term"]).groupBy("row", "term").agg(F.max("action").alias("kind"))
    placed = _occurrences(everything.where("text IS NOT NULL")).join(table(judged), ["row", "term"])
    return everything.select("doc_id", "row"), mentions.select("row", "kind", "start", "end").unionByName(placed.select("row", "kind", "start", "end"))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_<kind>, base_sha256, spans, and private, whether there are any."""
    everything, spans = _spans(docs, id_col, text_col)
    shown = F.concat_ws(":", "kind", "start", "end")
    of_row = spans.groupBy("row").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in PATTERNS), F.array_sort(F.collect_list(F.struct("start", _order(F.col("kind")).alias("o"), "end", shown.alias("s")))).alias("all"))
    joined = everything.join(of_row, "row", "left")
    text = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda x: x["s"]), ","), F.lit(""))
    base = text(F.filter("all", lambda x: x["o"] <= len(PATTERNS)))
    return joined.select("doc_id", *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in PATTERNS), F.sha2(base, 256).alias("base_sha256"), text(F.col("all")).alias("spans"), F.col("all").isNotNull().alias("private"))


def _class(word: Column) -> Column:
    """What a generalised term is shown as: the class of its shape."""
    return F.when(word == F.upper(word), "[ACRONYM]").when(F.left(word, F.lit(1)) != F.lower(F.left(word, F.lit(1))), "[NAME]").otherwise("[WORD]")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with spans replaced: base kinds by their name in brackets, general terms by the class of their shape
    (acronym, name or word), others left out.  Of spans that overlap, the union goes and the first one names it.
    """
    rows, row = numbered(docs)
    everything, spans = _spans(rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    found = fresh(rows, "_spans")
    of_row = spans.join(everything.select("row", F.col("doc_id").alias(row)), "row").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("last"), "kind"))).alias(found))
    text = F.col(text_col)
    part = lambda a, b: text.substr((a + 1).cast("int"), (b - a).cast("int"))
    label = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", _class(part(s["start"], -s["last"]))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    # Pieces are gathered in a list and joined once.
    step = lambda a, s: F.struct(F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(part(a["at"], s["start"]), label(s)))).alias("out"), F.greatest(a["at"], -s["last"]).alias("at"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), text.substr((a["at"] + 1).cast("int"), F.length(text))))
    return rows.join(of_row, row, "left").withColumn(text_col, F.coalesce(done, text)).select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
