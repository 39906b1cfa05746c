"""Spelling variants: words one edit apart are found, and each is grouped under its common form.

A word's mask holds for each letter whether the word has it an odd number of times. One inserted, deleted or replaced letter
flips one or two bits. The letters' bits are dealt to three bands, so two words one edit apart agree in at least one whole
band: they are joined where a band is equal. The length filter is part of the join's key: words meet by the length of the longer one
of a pair, so only equal lengths and lengths one apart do. So is an unchanged half: of two words one edit apart, either the first or the
last half of the longer one's letters is the same in both. That keeps the words of one key few, where a band alone would
hold a part of the vocabulary that grows with it. A pair counts at its first equal band only, so nothing is made distinct, and is
verified letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, written

#: Letters of a word, as a pattern.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points of a word at least, occurrences at least, times the occurrences of a word that its form must have.
LEAST_LETTERS, LEAST_OFTEN, TIMES = 7, 2, 10
BANDS = 3


def runs(text: Column, least: int = LEAST_LETTERS) -> Column:
    """All maximal runs of at least ``least`` letters, A-Z lower-cased. A null text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1)), F.array().cast("array<string>"))


def damaged(doc_id: Column, run: Column, every: int = 31) -> Column:
    """run, or without one of its letters where ``every`` divides the checksum of its document and itself. A null id damages nothing."""
    h = F.coalesce(F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run)), F.lit(1))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_often: int = LEAST_OFTEN) -> DataFrame:
    """(word, n): the distinct values of ``word`` long and frequent enough. Counted before they are shuffled; nulls don't count."""
    long_enough = words.where(F.char_length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_often)


def masks(word: Column) -> list[Column]:
    """The parity mask's bands. A letter's band is its code modulo 3, its bit the rest modulo 64: no two letters of LETTERS share a bit of a band."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(F.ascii(c) / BANDS) % 64).cast("int"))

    def band(b: int) -> Column:
        return F.aggregate(F.filter(letters, lambda c: F.ascii(c) % BANDS == b), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))

    return [band(b) for b in range(BANDS)]


def meetings(words: DataFrame) -> DataFrame:
    """words (word, n) with their bands, once for each key they meet others by.

    ``tag`` holds the longer length of a pair, the half and the band's number, ``key`` a hash of the half and the band. Twelve
    rows a word, in proportion to the vocabulary.
    """
    size = F.char_length("word")
    base = written(words.select("word", "n", size.alias("size"), *[m.alias(f"m{b}") for b, m in enumerate(masks(F.col("word")))]), "masks")
    longer = base.withColumn("longer", F.explode(F.array("size", F.col("size") + 1)))
    half = F.floor(F.col("longer") / 2).cast("int")
    halves = [F.substr("word", F.lit(1), half), F.substr("word", F.col("size") - half + 1, half)]
    at = [
        F.struct((F.col("longer") * 2 * BANDS + side * BANDS + b).alias("tag"), F.xxhash64(halves[side], f"m{b}").alias("key"))
        for side in (0, 1) for b in range(BANDS)
    ]
    return longer.withColumn("at", F.explode(F.array(*at))).select("at.tag", "at.key", "word", "n", *[f"m{b}" for b in range(BANDS)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b, for any two words exactly one inserted, deleted or replaced letter apart. words: (word, n), each word once.

    Words meet by key in a merge join, where Spark splits large keys; both sides are the same exchange. Words of any length
    are compared whole; ties don't matter; an empty table has no pairs.
    """
    rows = meetings(words)
    sides = [rows.select("tag", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("word", "n", *[f"m{b}" for b in range(BANDS)])]) for x in "ab"]
    a, b = F.col("a_word"), F.col("b_word")
    longer = F.floor(F.col("tag") / (2 * BANDS)).cast("int")
    side, band = F.floor(F.col("tag") / BANDS) % 2, F.col("tag") % BANDS
    apart = [F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}")) for k in range(BANDS)]
    first = F.when(apart[0] == 0, 0).when(apart[1] == 0, 1).when(apart[2] == 0, 2)
    half = F.floor(longer / 2).cast("int")
    by_start = F.substr(a, F.lit(1), half) == F.substr(b, F.lit(1), half)
    fits = (a < b) & (F.greatest(F.char_length(a), F.char_length(b)) == longer) & (band == first)
    near = fits & (F.bit_count(apart[0]) + F.bit_count(apart[1]) + F.bit_count(apart[2]) <= 2) & ((side == 0) | ~by_start)
    met_ = sides[0].hint("merge").join(sides[1], ["tag", "key"]).where(near)
    return met_.where(F.levenshtein(a, b, 1) == 1).select(a.alias("a"), "a_n", b.alias("b"), "b_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n) with n_near, form and form_n: the near word of largest n (ties: the smallest), if it is ``times`` as frequent."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    out = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    sure = -F.col("best.less") >= times * F.col("n")
    return out.select("word", "n", "n_near", F.when(sure, F.col("best.other")).alias("form"), F.when(sure, -F.col("best.less")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """found with ``root``: from word to form until there is none, the word itself if it has none.

    Only words with a form are followed, each round twice as far; a form is ``times`` as frequent as its word, so
    there is no way round and a few rounds do.
    """
    ways = written(found.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(words: DataFrame, least_letters: int = LEAST_LETTERS, least_often: int = LEAST_OFTEN, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words of a table of words as they occur.

    Words are compared as they are written; null words, and words too short or too rare, are no members. Repeated rows
    are what is counted. Other columns are left out. An empty table gives an empty result.
    """
    counted = written(vocabulary(words, least_letters, least_often), "vocabulary")
    found = written(forms(counted, near_pairs(counted), times), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31) -> DataFrame:
    """(word): every run of letters of every whole text, some damaged (see damaged()), so that variants are there to be found."""
    found = docs.select(F.col(id_col).alias("__id"), F.explode(runs(F.col(text_col))).alias("run"))
    return found.select(damaged(F.col("__id"), F.col("run"), every).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(words_of(documents(spark, sf_dir).select("doc_id", "text")))


def _sql() -> str:
    """The same in SQL, with words one edit apart found by the texts that are left when one letter is taken out."""
    table = "list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v))"
    crc = "xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::bigint + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::bigint), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with crc as (select {table} as t),
tokens as (select doc_id, unnest(regexp_extract_all({lower}, '[a-zÀ-ÿ]{{7,}}')) as run from documents where text is not null),
distinct_runs as (select doc_id, run, count(*) as times, encode(doc_id::varchar || ':' || run) as b from tokens group by all),
hashed as (select run, times, {crc} as h from distinct_runs, crc),
cut as (select case when h % 31 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from cut where length(word) >= 7 group by word having sum(times) >= 2),
less as (select word, n, i, left(word, i::bigint) || substr(word, i::bigint + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
),
ranked as (select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, encode(other)) as place from near),
best as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.other_n >= 10 * w.n then r.other end as form, case when r.other_n >= 10 * w.n then r.other_n end as form_n from words w left join ranked r on r.word = w.word and r.place = 1),
steps as (with recursive s as (select word, word as root, 0 as d from best union all select s.word, best.form, d + 1 from s join best on best.word = s.root where best.form is not null) select word, max_by(root, d) as root from s group by word)
select word, form, root, n, n_near, form_n from best join steps using (word)"""


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE = {"op12_spelling_variants": _sql()}
