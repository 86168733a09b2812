"""Registered queries of the signal operators, over the arrays of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import audio as S
from ..functions import text as X
from ..functions.tracking import timed, tracked
from ..operators import backends as B
from ..operators import reports as R
from .common import clip, query, rms, spread_out, words

V = "embedding::double[]"
_V = F.col


def _x():
    return F.col("embedding").cast("array<double>")


def _sum(x, digits=6):
    return F.round(S.total(x), digits)


def _out(e, x):
    """Length, sum and weighted sum of a signal: what tells signals apart."""
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return e.select("vec_id", F.size(x).alias("n"), _sum(x, 5).alias("total"), F.round(weighted, 4).alias("weighted"))


def _out_sql(x: str, source: str = "embeddings") -> str:
    return f"select vec_id, len(x)::int as n, round(list_sum(x), 5) as total, round(list_sum(list_transform(x, lambda v, i: v * i)), 4) as weighted from (select vec_id, {x} as x from {source})"


_SRC = f"(select vec_id, label, {V} as e from embeddings)"


@query("s1_rms", "embeddings", sql=f"select vec_id, round({rms('e')}, 9) as rms from {_SRC}")
def _(e):
    return e.select("vec_id", F.round(S.rms(_x()), 9).alias("rms"))


@query("s2_rms_normalise", "embeddings", sql=_out_sql(f"list_transform(e, lambda v: {clip(f'v * 0.05 / {rms('e')}')})", _SRC))
def _(e):
    return _out(e, S.rms_normalise(_x(), 0.05))


def _loud(x: str) -> str:
    return f"list_transform({x}, lambda v: {clip(f'v * pow(10.0, (-16.0 - 20 * log10({rms(x)} + 1e-10)) / 20)')})"


_LUFS = _loud("e")


@query("s3_loudness_normalise", "embeddings", sql=_out_sql(_LUFS, _SRC))
def _(e):
    return _out(e, S.loudness_normalise(_x()))


@query("s4_peak_normalise", "embeddings", sql=_out_sql("list_transform(e, lambda v: v * 0.95 / list_max(list_transform(e, lambda w: abs(w))))", _SRC))
def _(e):
    return _out(e, S.peak_normalise(_x()))


@query("s5_silence", "embeddings", sql="select vec_id, floor(24000 * (vec_id % 500) / 1000)::int as n from embeddings")
def _(e):
    return e.select("vec_id", F.size(S.silence((F.col("vec_id") % 500).cast("int"), 24000)).alias("n"))


_PAIR = f"(select vec_id, {V} as a, lead({V}) over (partition by label order by vec_id) as b from embeddings)"


def _pairs(e):
    return e.select("vec_id", _x().alias("a"), F.lead(_x()).over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")


def _fade(n: int, out: str, into: str, a: str = "a", b: str = "b") -> str:
    return f"list_concat(list_concat({a}[1:len({a}) - {n}], list_transform(range({n}), lambda i: {a}[len({a}) - {n} + i::int + 1] * {out} + {b}[i::int + 1] * {into})), {b}[{n + 1}:])"


@query("s6_hann_crossfade", "embeddings", sql=_out_sql(_fade(16, "pow(cos(i / 15.0 * pi() / 2), 2)", "pow(sin(i / 15.0 * pi() / 2), 2)"), f"(select * from {_PAIR} where b is not null)"))
def _(e):
    return _out(_pairs(e), S.hann_crossfade(F.col("a"), F.col("b"), 16))


@query("s7_linear_crossfade", "embeddings", sql=_out_sql(_fade(16, "(1 - i / 15.0)", "(i / 15.0)"), f"(select * from {_PAIR} where b is not null)"))
def _(e):
    return _out(_pairs(e), S.linear_crossfade(F.col("a"), F.col("b"), 16))


_NORM = _loud
_S8 = f"(select vec_id, list_concat(na, list_transform(range(case when vec_id % 2 = 0 then 50 else 20 end), lambda i: 0.0)) as a, nb as b from (select vec_id, {_NORM('a')} as na, {_NORM('b')} as nb from {_PAIR} where b is not null))"


@query("s8_splice", "embeddings", sql=_out_sql(_fade(10, "pow(cos(i / 9.0 * pi() / 2), 2)", "pow(sin(i / 9.0 * pi() / 2), 2)"), _S8))
def _(e):
    part = lambda c: F.struct(F.col(c).alias("samples"), (F.col("vec_id") % 2 == 0).alias("is_end"), F.lit(100).alias("fade_ms"))
    return _out(_pairs(e), S.splice(F.array(part("a"), part("b")), 100))


@query(
    "s9_splice_length", "embeddings",
    sql="select label, (sum(n) + sum(case when last then 0 else case when vec_id % 2 = 0 then 50 else 20 end end) - sum(case when last then 0 when n >= 10 then 10 else 0 end))::bigint as n from (select label, vec_id, len(embedding) as n, lead(vec_id) over (partition by label order by vec_id) is null as last from embeddings) group by label",
)
def _(e):
    last = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).isNull()
    rows = e.select("label", F.size("embedding").alias("n"), last.alias("last"), F.when(F.col("vec_id") % 2 == 0, 50).otherwise(20).alias("sil"))
    inner = ~F.col("last")
    return rows.groupBy("label").agg((F.sum("n") + F.sum(F.when(inner, F.col("sil")).otherwise(0)) - F.sum(F.when(inner & (F.col("n") >= 10), 10).otherwise(0))).alias("n"))


@query("s10_concatenate", "embeddings", sql=_out_sql(_fade(15, "(1 - i / 14.0)", "(i / 14.0)"), f"(select vec_id, list_concat(a, list_transform(range(50), lambda i: 0.0)) as a, b from {_PAIR} where b is not null)"))
def _(e):
    return _out(_pairs(e), S.linear_crossfade(F.concat("a", S.silence(500, 100)), F.col("b"), 15))


_QUIET = "list_transform(e, lambda v, i: case when (i - 1) // 8 % 3 = 0 then 0.0 else v end)"
_E8 = f"list_transform(range(len(q) // 8), lambda i: {rms('q[i * 8 + 1:i * 8 + 8]')})"
_S12 = f"(select *, list_avg(list_filter(en, lambda v: v > 0)) as lev from (select vec_id, {_E8} as en from (select vec_id, {_QUIET} as q from {_SRC})))"


def _gapped():
    return F.transform(_x(), lambda v, i: F.when(F.floor(i / 8) % 3 == 0, F.lit(0.0)).otherwise(v))


#: every seventh signal is silent, the others have gaps
_MUTED = "case when vec_id % 7 = 0 then list_transform(q, lambda v: 0.0) else q end"
_GAPS = f"(select *, list_transform(en, lambda v: v < coalesce(lev, 0) * 0.01) as quiet from (select *, list_avg(list_filter(en, lambda v: v > 0)) as lev from (select vec_id, {_E8} as en from (select vec_id, {_MUTED} as q from (select vec_id, {_QUIET} as q from {_SRC})))))"
_LONGEST = "list_max(list_transform(range(1, len(en) + 1), lambda i: list_max(list_transform(range(i, len(en) + 1), lambda j: case when list_bool_and(quiet[i:j]) then j - i + 1 else 0 end))))"


@query("s12_silence_check", "embeddings", sql=f"select vec_id, case when lev is null then 1.0 else round(len(list_filter(quiet, lambda v: v)) / len(en), 9) end::double as ratio, case when lev is null then 0.0 else round({_LONGEST} * 0.05, 9) end::double as longest_s, lev is null as silent from {_GAPS}")
def _(e):
    x = F.when(F.col("vec_id") % 7 == 0, F.transform(_x(), lambda v: F.lit(0.0))).otherwise(_gapped())
    r = e.select("vec_id", S.silence_report(x, 160, 0.05).alias("r"))
    return r.select("vec_id", F.round("r.ratio", 9).alias("ratio"), F.round("r.longest_s", 9).alias("longest_s"), "r.silent")


@query("w6_longest_run", "events", sql="select user_id, coalesce(max(n), 0)::int as longest from (select user_id, count(*) filter (event_type <> 'error') as n from (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) as g from events) group by user_id, g) group by user_id")
def _(events):
    by = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return by.select("user_id", S.longest_run(F.transform("s", lambda x: x["event_type"] != "error")).alias("longest"))


@query("s13_clipping", "embeddings", sql=f"select vec_id, round(len(list_filter(e, lambda v: abs(v) > 0.2)) / len(e), 9) as ratio from {_SRC}")
def _(e):
    return e.select("vec_id", F.round(S.clipping_ratio(_x(), 0.2), 9).alias("ratio"))


_S14 = f"(select vec_id, list_transform(range(len(e) // 4), lambda i: {rms('e[i * 4 + 1:i * 4 + 4]')}) as en from {_SRC})"
_Z = f"(select vec_id, list_transform(en, lambda v: (v - list_avg(en)) / (list_stddev_pop(en) + 1e-10)) as z, list_stddev_pop(en) as sd, len(en) as n from {_S14})"


@query("s14_repetition", "embeddings", sql=f"select vec_id, round(case when n > 10 and sd >= 1e-8 then greatest(0.0, list_max(list_transform(range(2, 10), lambda k: list_sum(list_transform(range(1, n - k + 1), lambda i: z[i] * z[i + k])) / (list_sum(list_transform(z, lambda v: v * v)) + 1e-10)))) else 0 end, 6) as score from {_Z}")
def _(e):
    return e.select("vec_id", F.round(S.repetition_score(_x(), 4), 6).alias("score"))


@query("s15_duration_issue", "lineitem", sql="select l_orderkey, l_linenumber, case when r > 2.5::double then 'RUNAWAY' when r > 1.8::double then 'LONG' when r < 0.3::double then 'SHORT' end as issue from (select l_orderkey, l_linenumber, l_quantity / nullif(l_tax * 1000, 0) as r from lineitem)")
def _(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", S.duration_issue(F.col("l_quantity"), F.col("l_tax") * 1000).alias("issue"))


_SCORE = "greatest(0.0, least(100.0, 100 - 20 * (l_linenumber % 3) - 5 * (l_linenumber % 4) - case when l_discount * 10 < 1 then (1 - l_discount * 10) * 40 else 0 end - case when l_tax * 10 > 0.3 then l_tax * 10 * 30 else 0 end))"


@query("s16_score", "lineitem", sql=f"select l_orderkey, l_linenumber, round({_SCORE}, 6)::double as score from lineitem")
def _(lineitem):
    n = F.col("l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", F.round(S.score(n % 3, n % 4, F.col("l_discount") * 10, F.col("l_tax") * 10), 6).alias("score"))


_S17 = f"""
with q as (select vec_id, {_QUIET} as e, 64 / 4.0 as dur, case when vec_id % 5 = 0 then 0.0 else 4.0 + vec_id % 60 end as want, case vec_id % 4 when 0 then null when 1 then 0.5 when 2 then 0.7 else 0.9 end as sim from {_SRC}),
g as (select *, list_transform(e, lambda v: sqrt(v * v)) as en from q),
l as (select *, list_avg(list_filter(en, lambda v: v > 0)) as lev from g),
m as (select *, len(list_filter(en, lambda v: v < lev * 0.01)) / len(en) as quiet, len(list_filter(e, lambda v: abs(v) > 0.2)) / len(e) as clip, case when want > 0 then dur / want end as ratio,
  list_transform(range(len(e) // 4), lambda i: {rms('e[i * 4 + 1:i * 4 + 4]')}) as sec from l),
z as (select *, list_stddev_pop(sec) as sd, list_transform(sec, lambda v: (v - list_avg(sec)) / (list_stddev_pop(sec) + 1e-10)) as zs from m),
r as (select *, case when len(sec) > 10 and sd >= 1e-8 then greatest(0.0, list_max(list_transform(range(2, 10), lambda k: list_sum(list_transform(range(1, len(zs) - k + 1), lambda i: zs[i] * zs[i + k])) / (list_sum(list_transform(zs, lambda v: v * v)) + 1e-10)))) else 0 end as rep from z),
s as (select vec_id, sim, rep, list_filter([case when ratio > 2.5 then 'RUNAWAY' end, case when quiet > 0.4 then 'MOSTLY_SILENT' end, case when clip > 0.2 then 'CLIPPING' end, case when rep > 0.3 then 'REPETITION' end, case when sim < 0.6 then 'GIBBERISH' end], lambda x: x is not null) as issues,
  list_filter([case when ratio > 1.8 and ratio <= 2.5 then 'LONG' end, case when ratio < 0.3 then 'SHORT' end, case when clip > 0.05 and clip <= 0.2 then 'MINOR_CLIPPING' end, case when rep > 0.2 and rep <= 0.3 then 'POSSIBLE_REPETITION' end, case when sim >= 0.6 and sim < 0.75 then 'MISMATCH' end], lambda x: x is not null) as warnings from r)
select vec_id, array_to_string(issues, ',') as issues, array_to_string(warnings, ',') as warnings, len(issues) = 0 as passed,
  round(greatest(0.0, least(100.0, 100 - 20 * len(issues) - 5 * len(warnings) - case when sim < 1 then (1 - sim) * 40 else 0 end - case when rep > 0.3 then rep * 30 else 0 end)), 4)::double as score from s
"""


@query("s17_quality_report", "embeddings", sql=_S17)
def _(e):
    k = F.col("vec_id")
    rows = e.select("vec_id", _gapped().alias("x"), F.when(k % 5 == 0, 0.0).otherwise(4.0 + k % 60).alias("want"), F.when(k % 4 == 1, 0.5).when(k % 4 == 2, 0.7).when(k % 4 == 3, 0.9).alias("sim"))
    limits = {"clipping_level": 0.2, "clipping_ratio_fail": 0.2, "clipping_ratio_warn": 0.05, "repetition_score_fail": 0.3, "repetition_score_warn": 0.2, "max_silence_s_fail": 1e9, "max_silence_s_warn": 1e8}
    report = R.quality_report(rows, "x", 4, "want", "sim", limits, window_samples=1)
    kinds = lambda c: F.array_join(F.transform(c, lambda m: F.split_part(m, F.lit(":"), F.lit(1))), ",").alias(c)
    return report.select("vec_id", kinds("issues"), kinds("warnings"), "passed", F.round("score", 4).alias("score"))


@query("s18_retry", "events", sql="select user_id, coalesce(min(event_id) filter (event_type = 'purchase'), max(event_id)) as attempt from events group by user_id")
def _(events):
    return B.retried(events, ["user_id"], F.col("event_type") == "purchase", "event_id").select("user_id", F.col("event_id").alias("attempt"))


@query(
    "s11_concatenate_chapters", "embeddings",
    sql=f"""with c as (select label, vec_id, {V} as x, row_number() over (partition by label order by vec_id) as i from embeddings where vec_id % 3 <> 0)
      select l.label, coalesce(n, 0)::int as n, total, case when n is null then 'no chapter has sound' end as error from (select distinct label from embeddings) l left join (select label, sum(len(x)) + 20 * (count(*) - 1) as n, round(list_sum(flatten(list(x order by vec_id))), 5) as total from c group by label) using (label)""",
)
def _(e):
    rows = e.select("label", "vec_id", F.when(F.col("vec_id") % 3 != 0, _x()).alias("x"))
    books = B.concatenate_chapters(rows, "label", "vec_id", "x", rate=10, to=10, silence_ms=2000, fade_ms=0)
    return books.select("label", F.coalesce(F.size("samples"), F.lit(0)).alias("n"), F.when(F.col("samples").isNotNull(), _sum(F.col("samples"), 5)).alias("total"), "error")


@query(
    "s11_chapter_parts", "embeddings",
    sql=f"""with c as (select label, {V} as x, row_number() over (partition by label order by vec_id) - 1 as i, sum(len(embedding)) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding) as b from embeddings where vec_id % 3 <> 0),
      p as (select label, (coalesce(b, 0) + 15 * i)::bigint as start, case when i = 0 then x else list_transform(x, lambda v, k: case when k <= 5 then v * ((k - 1) / 4.0) else v end) end as x from c
        union all select label, (b + 15 * i - 15)::bigint, list_transform(range(15), lambda k: 0.0::double) from c where i > 0)
      select label, start + k as start, len(x[k + 1:k + 40])::int as n, round(list_sum(x[k + 1:k + 40]), 5) as total from (select label, start, x, unnest(range(0, len(x), 40)) as k from p)""",
)
def _(e):
    rows = e.select("label", "vec_id", F.when(F.col("vec_id") % 3 != 0, _x()).alias("x"))
    parts = B.chapter_parts(rows, "label", "vec_id", "x", rate=10, to=10, silence_ms=2000, fade_ms=500, piece=40)
    return parts.select("label", "start", F.size("samples").alias("n"), _sum(F.col("samples"), 5).alias("total"))


@query("s19_silence_substitute", "documents", sql=f"select doc_id, case when doc_id % 3 = 0 then floor(240 * greatest(0.5::double, len({words('text')}) * 0.15::double))::int else 1 end as n from documents")
def _(docs):
    x = F.when(F.col("doc_id") % 3 == 0, S.empty()).otherwise(F.array(F.lit(1.0)))
    return docs.select("doc_id", F.size(S.or_silence(x, X.word_count(F.col("text")), 240)).alias("n"))


@query("s20_token_cap", "lineitem", sql="select l_orderkey, l_linenumber, greatest(72, least(180, floor(l_quantity * 12 * 1.3)::int)) as cap from lineitem")
def _(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", S.token_cap(F.col("l_quantity")).alias("cap"))


@query("s21_tail_carry", "embeddings", sql="select vec_id, round(list_sum(t), 5) as carried from (select vec_id, lag(e[len(e) - 7:]) over (partition by label order by vec_id) as t from (select vec_id, label, embedding::double[] as e from embeddings))")
def _(e):
    tail = F.lag(F.slice(_x(), -8, 8)).over(Window.partitionBy("label").orderBy("vec_id"))
    return e.select("vec_id", tail.alias("t")).select("vec_id", F.when(F.col("t").isNotNull(), _sum(F.col("t"), 5)).alias("carried"))


_POWER = "list_sum(list_transform(w, lambda v: v * v))"
_LAGS = "list_transform(range(1, 9), lambda k: {'r': list_sum(list_transform(range(1, 16 - k + 1), lambda i: w[i] * w[i + k])), 'k': -k})"
_S22 = f"""
with f as (select vec_id, e, unnest(range(4)) as i from {_SRC}), w as (select vec_id, i, e[i * 16 + 1:i * 16 + 16] as w from f),
b as (select vec_id, i, list_max({_LAGS}) as best, {_POWER} as power from w),
p as (select vec_id, i, case when best.r > 0 and best.r >= 0.3 * power then 160.0 / -best.k end::double as hz from b),
c as (select vec_id, coalesce(avg(hz), 150.0) as pitch_mean, coalesce(stddev_pop(hz), 0.0) as pitch_std, count(hz) as voiced, list(hz order by i) as hz from p group by vec_id)
select vec_id, round(pitch_mean, 6) as pitch_mean, round(pitch_std, 6) as pitch_std, round(case when voiced = 0 then 150.0 else list_sum(list_transform(hz, lambda v: coalesce(v, pitch_mean))) end, 5) as contour,
  round({rms('e')}, 6) as energy, 120.0::double as tempo, round(greatest(1.5, least(5.0, 2 + 20 * (list_sum(list_transform(range(1, len(e)), lambda i: ((e[i] >= 0) <> (e[i + 1] >= 0))::int)) / len(e)))), 6)::double as rate, 0.4::double as duration
from c join {_SRC} using (vec_id)
"""


@query("s22_prosody", "embeddings", sql=_S22)
def _(e):
    p = e.select("vec_id", _x().alias("x")).select("vec_id", "x", S.prosody(F.col("x"), 160, 16, 16, low=20, voiced=0.3).alias("p"))
    six = lambda c: F.round(f"p.{c}", 6).alias(c)
    return p.select("vec_id", six("pitch_mean"), six("pitch_std"), _sum(F.col("p.pitch_contour"), 5).alias("contour"), F.round(S.rms(F.col("x")), 6).alias("energy"), "p.tempo", F.round("p.speaking_rate", 6).alias("rate"), "p.duration")


@query(
    "s22_pitch_track", "conversations",
    sql="""select conv_id, turn, 110 + (list_sum(list_transform(string_split(role, ''), lambda c: ord(c))) + conv_id) % 220 as hz, true as near, true as steady
      from conversations where regexp_matches(text, '\\S')""",
)
def _(conv):
    """Each turn is spoken, fast, as a tone of known pitch and tracked: within 2 % on the average, and in nine of ten frames."""
    turns = spread_out(conv.select("conv_id", "turn", "role", "text", F.col("conv_id").cast("int").alias("seed")))
    spoken = B.synthesise(turns, "text", "role", "seed", B.tone(4000, 20)).where("samples is not null")
    hz = 110 + (F.aggregate(F.transform(F.split("role", ""), lambda c: F.ascii(c)), F.lit(0), lambda s, v: s + v) + F.col("conv_id")) % 220
    heard = tracked(spoken.select("conv_id", "turn", hz.alias("hz"), "samples"), "samples", 4000, pitch_only=True)
    off = F.filter("pitch_track", lambda v: F.abs(v / F.col("hz") - 1) <= 0.02)
    near = F.abs(S.pitch_mean(F.col("pitch_track")) / F.col("hz") - 1) <= 0.02
    return heard.select("conv_id", "turn", F.col("hz").cast("long").alias("hz"), near.alias("near"), (F.size(off) >= 0.9 * F.size("pitch_track")).alias("steady"))


def _clicks(beats, rate: int, seconds: int):
    """A click of 40 samples at every beat: one period is computed and repeated."""
    period = F.floor(60 * rate / beats).cast("int")
    click = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.sin(i * 1.5) * (1 - i / 40))
    one = F.slice(F.concat(click, F.array_repeat(F.lit(0.0), F.greatest(period - 40, F.lit(0)))), F.lit(1), period)
    return F.slice(F.flatten(F.array_repeat(one, F.ceil(rate * seconds / period).cast("int"))), 1, rate * seconds)


@query("s22_tempo", "supplier", sql="select s_suppkey, 50 + s_suppkey % 100 as beats, true as near from supplier")
def _(supplier):
    """A click track of each supplier, 50 to 149 beats a minute, whose tempo is found within 2 %."""
    rate, seconds = 4000, 10
    beats = 50 + F.col("s_suppkey") % 100
    heard = timed(spread_out(supplier, "s_suppkey").select("s_suppkey", beats.cast("long").alias("beats"), _clicks(beats, rate, seconds).alias("samples")), "samples", rate)
    return heard.select("s_suppkey", "beats", (F.abs(F.col("tempo") / F.col("beats") - 1) <= 0.02).alias("near"))
