"""Preference formatting: chosen and rejected conversations with a common prompt.

A pair's longest common prefix of turns is rendered once as the prompt; what follows on either side is rendered as its
completion, with the character spans that count in training (the assistant's turns; all else is masked).
The marks of the format never come from a text: ``<|`` in it is written ``<\\|``, and ``<\\`` is written ``<\\\\``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPAN = "array<struct<start:int,stop:int,train:boolean>>"


def plain(text: Column) -> Column:
    """A text without marks of the format, told apart from any other: what follows ``<\\`` is as it was. A null text is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def rendered(turns: Column) -> Column:
    """Turns as text: a header with the role, the text, an end mark."""
    return F.array_join(F.transform(turns, rendered_turn), "")


def rendered_turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def spans(turns: Column, target: str) -> Column:
    """Each turn's span in rendered(turns), and whether it is a target. The header is never one: a turn of the target role gives two spans."""
    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.char_length(t["role"]) + 5
        stop = head + F.char_length(t["text"]) + 8
        span = lambda a, b, on: F.struct(a.alias("start"), b.alias("stop"), F.lit(on).alias("train"))
        more = F.when(t["role"] == target, F.array(span(acc["at"], head, False), span(head, stop, True))).otherwise(F.array(span(acc["at"], stop, False)))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], more.cast(SPAN)).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


ONE = ["turn", "role", "text"]


def one_turn() -> Column:
    return F.struct("turn", plain(F.col("role")).alias("role"), plain(F.col("text")).alias("text"))


def paired(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each side's turns in order of (turn, role, text); see preference_rows()."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, one_turn()))).alias(s)
    turns = turns.where(F.col("side").isin("chosen", "rejected"))
    known = turns.where("pair_id is not null").groupBy("pair_id").agg(side("chosen"), side("rejected"))
    none = F.array().cast(known.schema["chosen"].dataType)
    alone = lambda s: F.when(F.col("side") == s, F.array(one_turn())).otherwise(none).alias(s)
    return known.unionByName(turns.where("pair_id is null").select("pair_id", alone("chosen"), alone("rejected")))


def partner_pairs(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """(pair_id, chosen, rejected) from conversations (conv_id, turn, role, text): chosen is the conversation, rejected the same with its last
    answer replaced by that of its partner, the conversation whose number differs in the last bit.

    Both sides have everything before that answer in common. There is no rejected side where either has no answer, or there
    is no partner. Each row without a conv_id is a conversation of its own.
    """
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one_turn())).alias("chosen"))
    from_end = F.array_position(F.reverse(F.transform("chosen", lambda t: t["role"])), F.lit(target))
    known = known.withColumn("at", F.when(from_end > 0, F.size("chosen") - from_end).cast("int"))  # place of the last answer, from 0
    other = known.where("at is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("chosen", F.col("at"))["text"].alias("other"))
    both = known.join(other, "conv_id", "left")
    none = F.array().cast(known.schema["chosen"].dataType)
    answer = F.struct(F.get("chosen", F.col("at"))["turn"].alias("turn"), F.lit(target).alias("role"), F.col("other").alias("text"))
    swapped = F.concat(F.slice("chosen", F.lit(1), F.col("at")), F.array(answer), F.slice("chosen", F.col("at") + 2, F.size("chosen")))
    pairs = both.select(F.col("conv_id").alias("pair_id"), "chosen", F.when(F.col("at").isNotNull() & F.col("other").isNotNull(), swapped).otherwise(none).alias("rejected"))
    alone = turns.where("conv_id is null").select(F.col("conv_id").alias("pair_id"), F.array(one_turn()).alias("chosen"), none.alias("rejected"))
    return pairs.unionByName(alone)


def formatted(pairs: DataFrame, target: str = "assistant") -> DataFrame:
    """One row a pair: n_common, prompt, and for both sides completion and spans. pairs: (pair_id, chosen, rejected)."""
    both = (F.size("chosen") > 0) & (F.size("rejected") > 0)
    pairs = pairs.withColumn("complete", both)
    pairs = pairs.withColumn("n_common", F.when(both, common_prefix(F.col("chosen"), F.col("rejected"))).otherwise(F.lit(0)).cast("int"))
    rest = lambda s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0)))
    pairs = pairs.withColumns({"c": rest("chosen"), "r": rest("rejected")})
    there = lambda s, c: F.when(F.size(s) > 0, c)
    return pairs.select(
        "pair_id", "complete", "n_common",
        F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected"),
        rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        there("chosen", rendered(F.col("c"))).alias("chosen"), there("chosen", spans(F.col("c"), target)).alias("chosen_spans"),
        there("rejected", rendered(F.col("r"))).alias("rejected"), there("rejected", spans(F.col("r"), target)).alias("rejected_spans"),
    )


def preference_rows(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """One row a pair: n_common, prompt, and for both sides completion and spans.

    turns: (pair_id, side ``chosen`` or ``rejected``, turn, role, text); other columns are left out, whatever their names. A
    side's turns are taken in order of (turn, role, text); null roles and texts count as empty, null turns come first,
    repeated rows stay. A pair with one side only has an empty prompt, null in place of the missing side and ``complete``
    false. Each row whose pair_id is null is a pair of its own; rows with another side are an error of the caller and are
    left out. Two equal sides are all prompt. Very long texts are rendered whole. An empty table gives an empty result.
    """
    return formatted(paired(turns), target)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations: chosen as it is, rejected with its partner's last answer."""
    pairs = partner_pairs(documents(spark, sf_dir, "conversations"))
    mask = lambda s: F.transform(s, lambda x: F.concat_ws(":", x["start"], x["stop"], x["train"].cast("int")))
    return formatted(pairs).withColumns({"chosen_spans": F.array_join(mask("chosen_spans"), ","), "rejected_spans": F.array_join(mask("rejected_spans"), ",")})


ORACLE_10 = r"""
with turns as (
  select conv_id, turn, replace(replace(coalesce(role, ''), '<\', '<\\'), '<|', '<\|') as role, replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') as text
  from conversations),
side as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as c from turns where conv_id is not null group by conv_id
  union all select conv_id, [{'role': role, 'text': text}] from turns where conv_id is null),
answer as (select *, list_max([i for i in range(1, len(c) + 1) if c[i].role = 'assistant']) as pos from side),
pair as (
  select a.conv_id as pair_id, a.c, case when a.pos is not null and o.pos is not null then
    list_transform(range(1, len(a.c) + 1), lambda i: case when i = a.pos then {'role': 'assistant', 'text': o.c[o.pos].text} else a.c[i] end) end as r
  from answer a left join answer o on o.conv_id = xor(a.conv_id, 1)),
place as (
  select *, coalesce(len(list_filter(range(least(len(c), len(r))), lambda i:
    len(list_filter(range(i + 1), lambda j: c[j + 1] = r[j + 1])) = i + 1)), 0) as n_common from pair),
cut as (select *, c[n_common + 1:] as crest, r[n_common + 1:] as rrest from place),
piece as (
  select pair_id, 'c' as side, unnest(crest) as t, unnest(range(len(crest))) as i from cut where c is not null
  union all select pair_id, 'r', unnest(rrest), unnest(range(len(rrest))) from cut where r is not null),
sized as (
  select *, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) as shown, length(t.role) + 5 as head, length(t.text) + 8 as body from piece),
placed as (select *, coalesce(sum(head + body) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0)::bigint as begins from sized),
done as (
  select pair_id, side, string_agg(shown, '' order by i) as shown,
    string_agg(case when t.role = 'assistant' then begins || ':' || (begins + head) || ':0,' || (begins + head) || ':' || (begins + head + body) || ':1'
      else begins || ':' || (begins + head + body) || ':0' end, ',' order by i) as spans
  from placed group by pair_id, side)
select cut.pair_id, c is not null and r is not null as complete, n_common::int as n_common,
  coalesce(len(c), 0)::int as n_chosen, coalesce(len(r), 0)::int as n_rejected,
  array_to_string(list_transform(c[1:n_common], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as prompt,
  case when c is not null then coalesce(dc.shown, '') end as chosen, case when c is not null then coalesce(dc.spans, '') end as chosen_spans,
  case when r is not null then coalesce(dr.shown, '') end as rejected, case when r is not null then coalesce(dr.spans, '') end as rejected_spans
from cut left join done dc on dc.pair_id = cut.pair_id and dc.side = 'c' left join done dr on dr.pair_id = cut.pair_id and dr.side = 'r'
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLE = {"op10_chat_format": ORACLE_10}
