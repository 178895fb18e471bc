"""Preference pairs: one prompt for what chosen and rejected conversations share, and masked completions.

The longest common prefix of turns, equal in role and text, is rendered once as the
prompt. What follows on either side is rendered as its completion, together with the
character spans a loss may count: the text and end mark of assistant turns. All of it
is DataFrame functions over one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.store import written
from pactline.llm.text import table

START, END, AFTER = "<|im_start|>", "<|im_end|>", "\n"
ANSWERS = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: each conversation's turns in order; a null role is "unknown", a null text empty.

    Turns of equal number are ordered by role and text, those without number come
    first; repeated turns stay. The list is the conversation itself, as it is rendered.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    lists = turns.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return lists.select(key, plain.alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two lists have in common from the start."""
    n = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(apart), n))


def rendered(turns: Column) -> Column:
    each = F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + AFTER)))
    return F.array_join(each, "")


def answer_spans(turns: Column) -> Column:
    """start:end of what counts towards the loss, in characters of the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(START) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        spans = F.when(t["role"] == ANSWERS, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(AFTER)).cast("int").alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["spans"]), ",")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, and text and spans of both completions.

    pairs has pair_id, chosen and rejected, lists of turns (role, text). Pairs that
    are equal, or of which a side has no assistant turn after the common prefix, say
    nothing about preference and are left out; so are null lists. Other columns are
    ignored. No rows give no rows.
    """
    split = pairs.filter("chosen is not null and rejected is not null").select(
        "pair_id", "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("prompt_turns")
    )
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    split = split.withColumns({"_prompt": F.slice("chosen", F.lit(1), F.col("prompt_turns")), "_chosen": rest("chosen"), "_rejected": rest("rejected")})
    answered = lambda c: F.exists(c, lambda t: t["role"] == ANSWERS)
    return split.filter(answered("_chosen") & answered("_rejected")).select(
        "pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), rendered(F.col("_prompt")).alias("prompt"),
        rendered(F.col("_chosen")).alias("chosen"), answer_spans(F.col("_chosen")).alias("chosen_spans"),
        rendered(F.col("_rejected")).alias("rejected"), answer_spans(F.col("_rejected")).alias("rejected_spans"),
    )


def next_different(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, next: the first following key whose value is another, in order of keys and from the last on to the first.

    Keys differ; they may be of any type that has an order. next is null where all values
    are equal. Keys are dealt into ranges; inside a range one pass tells where the value
    changes. Of each range only its ends go on, and their number is that of partitions.
    """
    cut = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange("key")
    cut = written(cut.withColumn("slice", F.spark_partition_id()))
    own = W.partitionBy("slice")
    changed = F.col("value") != F.lag("value").over(own.orderBy("key"))
    cut = cut.withColumn("start", F.when(changed, F.col("key")))
    ahead = own.orderBy(F.desc("key")).rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("next", F.last("start", ignorenulls=True).over(ahead))
    ends = written(cut.groupBy("slice").agg(
        F.min("key").alias("first"), F.min_by("value", "key").alias("first_value"), F.min("start").alias("second"), F.max_by("value", "key").alias("last_value")
    ))
    listed = ends.agg(F.array_sort(F.collect_list(F.struct("slice", "first", "first_value", "second")))).scalar()
    ends = ends.select("slice", "last_value", listed.alias("all"))
    around = F.concat(F.filter("all", lambda s: s["slice"] > F.col("slice")), F.filter("all", lambda s: s["slice"] <= F.col("slice")))
    other = F.transform(around, lambda s: F.when(s["first_value"] != F.col("last_value"), s["first"]).otherwise(s["second"]))
    beyond = ends.select("slice", F.get(F.array_compact(other), 0).alias("beyond"))
    return cut.join(F.broadcast(beyond), "slice").select("key", F.coalesce("next", "beyond").alias("next"))


def sampled_pairs(lists: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs of each conversation up to its last answer and the same one that goes on, from its middle answer, as another does.

    The other is the next conversation by key whose middle answer is different. A
    conversation without an answer has no pair; nor has any if all middle answers are equal.
    """
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["role"] == ANSWERS)
    cut = lists.filter(F.exists("turns", lambda t: t["role"] == ANSWERS)).withColumn("places", places)
    middle = F.element_at("places", ((F.size("places") + 1) / 2).cast("int"))
    cut = cut.select(F.col(key).alias("pair_id"), "turns", middle.alias("at"), F.array_max("places").alias("last"))
    onward = F.slice("turns", F.col("at"), F.col("last") - F.col("at") + 1)
    answers = cut.select("pair_id", F.xxhash64(F.element_at("turns", F.col("at"))["text"]).alias("answer"))
    givers = next_different(answers, "pair_id", "answer").filter("next is not null")
    chosen = cut.select("pair_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), "at")
    donors = cut.select(F.col("pair_id").alias("donor"), onward.alias("onward"))
    joined = chosen.join(givers, F.col("pair_id") == F.col("key")).join(donors, F.col("next") == F.col("donor"))
    rejected = F.concat(F.slice("chosen", F.lit(1), F.col("at") - 1), "onward")
    return joined.select("pair_id", "chosen", rejected.alias("rejected"))


def op4_preference_pairs(spark, sf_dir: str) -> DataFrame:
    lists = conversations(table(spark, sf_dir, "conversations"))
    return preference_pairs(sampled_pairs(lists)).withColumnRenamed("pair_id", "conv_id")


OP4_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as i,
    coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null
), l as (
  select conv_id, max(i) as last, list(i order by i)[(count(*) + 1) // 2] as mid from t where role = 'assistant' group by conv_id
), a as (select l.*, t.text as answer from l join t on t.conv_id = l.conv_id and t.i = l.mid),
d as (
  select conv_id, mid, coalesce((select min(b.conv_id) from a b where b.conv_id > a.conv_id and b.answer <> a.answer),
    (select min(b.conv_id) from a b where b.answer <> a.answer)) as donor from a
), s as (
  select a.conv_id, 'chosen' as side, t.i as place, t.role, t.text from a join t on t.conv_id = a.conv_id where t.i <= a.last
  union all select d.conv_id, 'rejected', t.i, t.role, t.text from d join t on t.conv_id = d.conv_id where t.i < d.mid and d.donor is not null
  union all select d.conv_id, 'rejected', d.mid + t.i - x.mid, t.role, t.text
    from d join a x on x.conv_id = d.donor join t on t.conv_id = d.donor and t.i between x.mid and x.last
), p as (
  select conv_id, min(place) filter (c.role is distinct from r.role or c.text is distinct from r.text) - 1 as prompt_turns
  from (select * from s where side = 'chosen') c full join (select * from s where side = 'rejected') r using (conv_id, place) group by conv_id
), w as (
  select s.*, p.prompt_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown, place <= prompt_turns as shared,
    sum(24 + length(role) + length(text)) over (partition by conv_id, side, place <= prompt_turns order by place) - 1 as stop
  from s join p using (conv_id)
), c as (
  select conv_id, side, string_agg(shown, '' order by place) filter (not shared) as body, string_agg(shown, '' order by place) filter (shared) as prompt,
    string_agg((stop - 10 - length(text)) || ':' || stop, ',' order by place) filter (not shared and role = 'assistant') as spans
  from w group by conv_id, side
)
select x.conv_id, p.prompt_turns::bigint as prompt_turns, coalesce(x.prompt, '') as prompt, x.body as chosen, x.spans as chosen_spans,
  y.body as rejected, y.spans as rejected_spans
from c x join c y using (conv_id) join p using (conv_id)
where x.side = 'chosen' and y.side = 'rejected' and x.spans is not null and y.spans is not null
"""
