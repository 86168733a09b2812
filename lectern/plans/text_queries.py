"""Registered queries of the text operators, over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vocab
from ..operators import chapters as C
from ..sources import table_functions
from .common import any_of, duration, listed, pieces, query, sentences, sentences_by_capital, strip, words

LINES = r"\n+"
PARAS = pieces("text", r"\n+")
#: vocabularies that occur in the tables
EMOTIONS = {"angry": ("reed", "sting", "blest"), "sad": ("ingsh", "onwh", "thth"), "happy": ("anre", "eles", "ción"), "fearful": ("ouve", "ntha"), "tender": ("lich", "ung")}
EMPHASES = {"whispered": ("with", "der"), "shouted": ("was", "que"), "soft": ("this", "les"), "strong": ("that", "und")}
BODIES = (r"(?i)licen[sc]ed?\s+under", r"(?i)general\s+public", r"(?i)version\s+\d", r"(?i)copyright", r"(?i)the\s+of")
NAMES = vocab.NAME_PATTERN


@query("t1_paragraph_split", "documents", sql=f'select doc_id, unnest(range(len(p)))::int as "at", unnest(p) as paragraph from (select doc_id, {PARAS} as p from documents)')
def _(docs):
    return docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), LINES)).alias("at", "paragraph"))


@query("t2_sentences_by_capital", "documents", sql=f'select doc_id, unnest(range(len(s)))::int as "at", unnest(s) as sentence from (select doc_id, {sentences_by_capital("text")} as s from documents)')
def _(docs):
    return docs.select("doc_id", F.posexplode(X.sentences_by_capital(F.col("text"))).alias("at", "sentence"))


@query("t3_sentences", "documents", sql=f'select doc_id, p, unnest(range(len(s)))::int as "at", unnest(s) as sentence from (select doc_id, p, {sentences("q")} as s from (select doc_id, unnest(range(len(x)))::int as p, unnest(x) as q from (select doc_id, {PARAS} as x from documents)))')
def _(docs):
    paras = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), LINES)).alias("p", "q"))
    return paras.select("doc_id", "p", F.posexplode(X.sentences(F.col("q"))).alias("at", "sentence"))


_SPANS = r"""list_transform(regexp_extract_all(q, '["“][^"”“]+["”]', 0), lambda m: m)"""
_T5 = f"""
with p as (select doc_id, unnest(range(len(x)))::int as paragraph_index, unnest(x) as q from (select doc_id, {PARAS} as x from documents)),
s as (select doc_id, paragraph_index, q, len(s) as n, unnest(range(len(s)))::int as "at", unnest(s) as text from (select *, {sentences_by_capital('q')} as s from p)),
m as (select doc_id, paragraph_index, regexp_replace(q, '["“]([^"”“]+)["”]', chr(1) || '\\1' || chr(1), 'g') as masked from p)
select doc_id, paragraph_index, (row_number() over (partition by doc_id order by paragraph_index, "at") - 1)::int as "index", text,
  instr(q, text) > 0 and contains(substr(masked, instr(q, text), length(text)), chr(1)) as is_dialogue, "at" = 0 as is_paragraph_start, "at" = n - 1 as is_paragraph_end
from s join m using (doc_id, paragraph_index)
"""


@query("t5_sentence_records", "documents", sql=_T5)
def _(docs):
    return C.sentence_records(docs, "doc_id", delimiter=LINES)


@query("t6_quoted_spans", "documents", sql="select doc_id, unnest(regexp_extract_all(text, '[\"“]([^\"”“]+)[\"”]', 1)) as quote from documents")
def _(docs):
    return docs.select("doc_id", F.explode(X.quoted(F.col("text"))).alias("quote"))


@query("t7_dialogue_sentences", "documents", sql=f"select doc_id, count(*) filter (is_dialogue) as n_dialogue, count(*) as n from ({_T5}) group by doc_id")
def _(docs):
    return C.sentence_records(docs, "doc_id", delimiter=LINES).groupBy("doc_id").agg(F.count_if("is_dialogue").alias("n_dialogue"), F.count("*").alias("n"))


_VERBS = ("the", "of", "and", "was", "que", "der", "la")
_NEAR = f"[,.]?\\s*(?:(?:{'|'.join(_VERBS)})\\s+{NAMES}|{NAMES}\\s+(?:{'|'.join(_VERBS)}))"
#: texts with dialogue: every line is followed by itself in quotes, two closing forms in turn, and by its own end
_TALK = """select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || chr(10) || '“' || translate(x, '"“”', '   ') || case when i % 2 = 1 then '” la ' else '" ' end || right(x, 40)), chr(10)) as text from documents"""
_T8 = f"""
with p as (select doc_id, unnest(range(len(x)))::int as paragraph, unnest(x) as q from (select doc_id, {PARAS} as x from ({_TALK}))),
m as (select *, string_split(regexp_replace(q, '["“]([^"”“]+)["”]', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as part from p),
k as (select doc_id, paragraph, q, part, unnest(range(len(part))) as i, unnest(part) as piece from m),
s as (select *, (list_sum(list_transform(part[1:i], lambda x: length(x))) + i - 1)::int as s, split_part(piece, chr(2), 1) as quote, split_part(piece, chr(2), 2) as after from k),
r as (select doc_id, paragraph, q, 2 * i as "at", 'narration' as type, {strip("case when i = 0 then piece else after end")} as text, null::int as s, null::int as e from s
  union all select doc_id, paragraph, q, 2 * i - 1, 'dialogue', {strip('quote')}, s, s + length(quote) + 2 from s where i > 0),
w as (select *, left(q[e + 1:], 150) as a, right(left(q, s), 150) as b from r where text <> '')
select doc_id, paragraph, "at"::int as "at", type, text, case when type = 'dialogue' then coalesce(nullif(regexp_extract(a, '{_NEAR}', 1), ''), nullif(regexp_extract(a, '{_NEAR}', 2), ''), nullif(regexp_extract(b, '{NAMES}\\s+(?:{'|'.join(_VERBS)})[,:]?\\s*$', 1), '')) end as speaker from w
"""


def _talk(docs):
    quoted = lambda x, i: F.concat(x, F.lit("\n“"), F.translate(x, '"“”', "   "), F.when(i % 2 == 0, "” la ").otherwise('" '), F.right(x, F.lit(40)))
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), quoted), "\n").alias("text"))


@query("t8_dialogue_segments", "documents", sql=f'select doc_id, paragraph, "at", type, text from ({_T8})')
def _(docs):
    return C.dialogue_segments(_talk(docs), "doc_id", delimiter=LINES, verbs=_VERBS).drop("speaker")


@query("t9_speaker_attribution", "documents", sql=f"""select doc_id, paragraph, "at", speaker from ({_T8}) where type = 'dialogue'""")
def _(docs):
    return C.dialogue_segments(_talk(docs), "doc_id", delimiter=LINES, verbs=_VERBS).where("type = 'dialogue'").select("doc_id", "paragraph", "at", "speaker")


_T10 = f"""
with k as (select conv_id, turn, case when role = 'assistant' then 'dialogue' else 'narration' end as type, {strip('text')} as text from conversations),
l as (select *, coalesce(type = 'narration' and lag(type) over (partition by conv_id order by turn) = 'narration' and len({words('text')}) < 12, false) as joins from k),
g as (select *, sum(case when joins then 0 else 1 end) over (partition by conv_id order by turn) as number from l)
select conv_id, number::bigint as number, arg_min(type, turn) as type, string_agg(text, ' ' order by turn) as text from g group by conv_id, number
"""


@query("t10_merge_short", "conversations", sql=_T10)
def _(conv):
    typed = conv.select("conv_id", "turn", F.when(F.col("role") == "assistant", "dialogue").otherwise("narration").alias("type"), X.strip(F.col("text")).alias("text"), F.col("role").alias("speaker"))
    return C.merge_short_narration(typed, "conv_id", ["turn"], 12).select("conv_id", "number", "type", "text")


#: texts with straight quotes around every second line, and one unpaired quote in some
_LEGACY = """select doc_id, array_to_string(list_transform(list_filter(string_split(replace(text, '"', ' '), chr(10)), lambda x: x <> ''), lambda x, i: case when i % 2 = 0 then '"' || x || '" Tom said of it.' else x end), chr(10)) || case when doc_id % 5 = 0 then ' " open' else '' end as text from documents"""
_T12 = ", ".join(f"nullif(regexp_extract({side}, '{p}', 1), '')" for side, patterns in (("a", C.LEGACY_AFTER), ("b", C.LEGACY_BEFORE)) for p in patterns)
_T11 = f"""
with q as (select doc_id, text, string_split(text, '"') as part from ({_LEGACY})),
n as (select *, (len(part) - 1) // 2 as pairs, list_transform(range(1, len(part) + 1), lambda i: (list_sum(list_transform(part[1:i], lambda x: length(x))) + i - 1)::int) as ends from q),
d as (select doc_id, text, part, ends, pairs, unnest(range(pairs)) as k from n),
e as (select *, {strip('part[2 * k + 2]')} as said, ends[2 * k + 3] as stop, case when k = 0 then 0 else ends[2 * k + 1] end as start from d),
s as (select doc_id, k, 'dialogue' as type, said as text, text[stop + 1:stop + 100] as a, right(left(text, start), 100) as b from e where said <> ''
  union all select doc_id, 1000000, 'narration', {strip('case when pairs = 0 then text else text[ends[2 * pairs + 1] + 1:] end')}, null, null from n where {strip('case when pairs = 0 then text else text[ends[2 * pairs + 1] + 1:] end')} <> '' or pairs = 0)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as "at", type, text, case when type = 'dialogue' then coalesce({_T12}) end as speaker from s
"""


def _legacy(docs):
    lines = F.filter(F.split(F.replace("text", F.lit('"'), F.lit(" ")), "\n"), lambda x: x != "")
    quoted = F.transform(lines, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit('"'), x, F.lit('" Tom said of it.'))).otherwise(x))
    return docs.select("doc_id", F.concat(F.array_join(quoted, "\n"), F.when(F.col("doc_id") % 5 == 0, ' " open').otherwise("")).alias("text"))


@query("t11_legacy_dialogue", "documents", sql=f'select doc_id, "at", type, text from ({_T11})')
def _(docs):
    return C.legacy_dialogue(_legacy(docs), "doc_id").drop("speaker")


@query("t12_legacy_speaker", "documents", sql=f'select doc_id, "at", speaker from ({_T11}) where type = \'dialogue\'')
def _(docs):
    return C.legacy_dialogue(_legacy(docs), "doc_id").where("type = 'dialogue'").select("doc_id", "at", "speaker")


@query("t13_word_count", "documents", sql=f"select doc_id, len({words('text')})::int as n_words from documents")
def _(docs):
    return docs.select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query("t14_duration", "documents", sql=f"select doc_id, {duration('text')}::double as seconds from documents")
def _(docs):
    return docs.select("doc_id", X.duration(F.col("text")).alias("seconds"))


@query("t15_adaptive_pace", "events", sql="select event_id, case when event_type in ('view', 'purchase') then 1.8 when event_type = 'error' then 3.2 else 2.5 end::double as pace from events")
def _(events):
    pacing = F.when(F.col("event_type") == "view", "slow").when(F.col("event_type") == "error", "urgent")
    return events.select("event_id", X.pace(pacing, F.when(F.col("event_type") == "purchase", "whispered").otherwise("normal"), F.lit(None).cast("string")).cast("double").alias("pace"))



def _packed(docs):
    timed = docs.select("doc_id", C.chunk_sentences(F.col("text"), delimiter=LINES).alias("s"))
    return timed.select("doc_id", C.pack_chunks(F.col("s"), 10.0, 12.0).alias("c"))


_T16 = f"""
with recursive s as (
  select doc_id, row_number() over (partition by doc_id order by p, "at") as i, sentence, "at" = n - 1 as e, {duration('sentence')}::double as d
  from (select doc_id, p, len(s) as n, unnest(range(len(s))) as "at", unnest(s) as sentence from (select doc_id, p, {sentences('q')} as s from (select doc_id, unnest(range(len(x))) as p, unnest(x) as q from (select doc_id, {PARAS} as x from documents))))),
f(doc_id, i, chunk, d, open) as (
  select doc_id, i, 0, d, not (e and d >= 3.0) from s where i = 1
  union all
  select s.doc_id, s.i, f.chunk + case when f.open and f.d + s.d <= 12.0 then 0 else 1 end,
    case when f.open and f.d + s.d <= 12.0 then f.d + s.d else s.d end,
    not (s.e and (case when f.open and f.d + s.d <= 12.0 then f.d + s.d else s.d end) >= 3.0)
  from f join s on s.doc_id = f.doc_id and s.i = f.i + 1)
select f.doc_id, chunk::int as chunk, string_agg(sentence, ' ' order by f.i) as text, round(arg_max(f.d, f.i), 6) as seconds, count(*)::int as n, arg_max(s.e, f.i) as is_end
from f join s on s.doc_id = f.doc_id and s.i = f.i group by f.doc_id, chunk
"""


@query("t16_greedy_chunks", "documents", sql=_T16)
def _(docs):
    out = C.exploded(_packed(docs), "doc_id", F.col("c"), "chunk", "c")
    return out.select("doc_id", "chunk", "c.text", F.round("c.seconds", 6).alias("seconds"), F.size("c.indices").alias("n"), "c.is_end")


_T16_SPLIT = _T16.replace("round(arg_max(f.d, f.i), 6) as seconds, count(*)::int as n", "arg_max(f.d, f.i) as seconds, min(f.i)::int - 1 as lo, max(f.i)::int as hi")
_T17 = f"""
with recursive c as (select * from ({_T16_SPLIT})),
p as (select *, case when seconds > 12::double * 1.2::double then {pieces("regexp_replace(text, '([,;:—-])" + chr(92) + "s+', '" + chr(92) + "1' || chr(1), 'g')", chr(92) + "x01")} else [] end as parts from c),
u as (select doc_id, chunk, lo, hi, is_end, unnest(range(1, len(parts) + 1)) as i, unnest(parts) as part, len(parts) as m from p where len(parts) > 1),
d as (select *, {duration('part')}::double as s from u),
f(doc_id, chunk, i, g, t) as (select doc_id, chunk, i, 0, s from d where i = 1 union all
  select d.doc_id, d.chunk, d.i, case when f.t + d.s > 12 then f.g + 1 else f.g end, case when f.t + d.s > 12 then d.s else f.t + d.s end from f join d on d.doc_id = f.doc_id and d.chunk = f.chunk and d.i = f.i + 1),
o as (select doc_id, chunk, 0 as g, text, seconds, lo, hi, is_end from p where len(parts) <= 1
  union all select f.doc_id, f.chunk, g, string_agg(part, ' ' order by f.i), arg_max(t, f.i), any_value(lo), any_value(hi), any_value(is_end) and max(f.i) = any_value(m) from f join d on d.doc_id = f.doc_id and d.chunk = f.chunk and d.i = f.i group by f.doc_id, f.chunk, g)
select doc_id, (row_number() over (partition by doc_id order by chunk, g) - 1)::int as chunk, text, round(seconds, 6) as seconds, lo as first, hi - lo as n, is_end from o
"""


@query("t17_oversize_split", "documents", sql=_T17)
def _(docs):
    split = C.exploded(_packed(docs), "doc_id", C.split_oversize(F.col("c"), 12.0), "chunk", "c")
    return split.select("doc_id", "chunk", "c.text", F.round("c.seconds", 6).alias("seconds"), F.element_at("c.indices", 1).alias("first"), F.size("c.indices").alias("n"), "c.is_end")


_T18 = f"""
select doc_id, {any_of('source', ['(?i)^src1$', '(?i)^src7$'])}
  or ({' + '.join(f"regexp_matches(left(text, 2000), '{p}')::int" for p in BODIES)}) >= 2
  or (len(l) > 5 and len(list_filter(l, lambda x: length(x) < 40)) / len(l) > 0.7) as is_boilerplate
from (select *, {pieces('left(text, 2000)', chr(92) + 'n')} as l from documents)
"""


@query("t18_boilerplate_chapter", "documents", sql=_T18)
def _(docs):
    return docs.select("doc_id", X.is_boilerplate_chapter(F.col("source"), F.col("text"), ("(?i)^src1$", "(?i)^src7$"), BODIES).alias("is_boilerplate"))


@query("t19_boilerplate_segment", "documents", sql=f"select doc_id, {any_of(strip('text'), [*BODIES[:4], '(?i)^the' + chr(92) + 's+'])} as is_boilerplate from documents")
def _(docs):
    return docs.select("doc_id", X.is_boilerplate_segment(F.col("text"), BODIES[:4], (r"(?i)^the\s+",)).alias("is_boilerplate"))


_EMOTION = (
    "case when greatest("
    + ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in own) + ")" for own in EMOTIONS.values())
    + ") = 0 then 'neutral' "
    + " ".join(
        "when ("
        + " + ".join(f"contains(lower(text), '{w}')::int" for w in own)
        + ") = greatest("
        + ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in o) + ")" for o in EMOTIONS.values())
        + f") then '{name}'"
        for name, own in EMOTIONS.items()
    )
    + " end"
)


@query("t20_emotion", "documents", sql=f"select doc_id, {_EMOTION} as emotion from documents")
def _(docs):
    return docs.select("doc_id", X.emotion(F.col("text"), EMOTIONS).alias("emotion"))


_EMPHASIS = (
    "case "
    + " ".join(f"when regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(own)})(?:$|[^\\p{{L}}\\p{{N}}_])') then '{name}'" for name, own in EMPHASES.items())
    + r" when len(regexp_extract_all(text, '\b[A-Z]{2,}\b')) > 2 then 'shouted' when regexp_matches(text, '\*[^*]+\*|_[^_]+_') then 'emphasized' else 'normal' end"
)


@query("t21_emphasis", "conversations", sql=f"select conv_id, turn, {_EMPHASIS} as emphasis from conversations")
def _(conv):
    return conv.select("conv_id", "turn", X.emphasis(F.col("text"), EMPHASES).alias("emphasis"))


_PACING = f"""case when len(s) = 0 then 'normal' when m < 5 then 'fast' when m > 20 then 'slow' when length(text) - length(replace(text, '!', '')) > 2 then 'urgent' else 'normal' end"""


@query("t22_pacing", "documents", sql=f"select doc_id, {_PACING} as pacing from (select *, list_sum(list_transform(s, lambda x: len({words('x')}))) / len(s) as m from (select doc_id, text, {pieces('text', '[.!?]+')} as s from documents))")
def _(docs):
    return docs.select("doc_id", X.pacing(F.col("text")).alias("pacing"))


_T23 = f"""
with recursive s as (
  select doc_id, "index" as i, len({words('text')}) as w, is_dialogue as dlg, is_paragraph_start as st, {_EMOTION} as emo,
    case when regexp_matches(text, '(?i)\\b(?:with|was)\\b') then 'soft' else 'normal' end as emp from ({_T5})),
f(doc_id, i, g, n, words, absorbed, dlg, emo, emp) as (
  select doc_id, i, 0, 1, w, false, dlg, emo, emp from s where i = 0
  union all
  select doc_id, i, g + cut::int, case when cut then 1 else n + 1 end, case when cut then w else words + w end, case when cut then false else absorbed or absorb end, sdlg, semo, semp
  from (select *, case when sdlg <> dlg then true when sdlg then false when turn then not absorb else st or n >= 4 or words + w > 80 end as cut
    from (select *, not sdlg and not dlg and turn and not absorbed and words + w <= 110 as absorb
      from (select f.*, s.i as si, s.w, s.st, s.dlg as sdlg, s.emo as semo, s.emp as semp, (f.emo <> s.emo or f.emp <> s.emp) as turn from f join s on s.doc_id = f.doc_id and s.i = f.i + 1)) q) r(doc_id, oi, g, n, words, absorbed, dlg, emo, emp, i, w, st, sdlg, semo, semp, turn, absorb, cut))
select doc_id, i::int as "index", g::int as segment from f
"""


@query("t23_segments", "documents", sql=_T23)
def _(docs):
    def told(s):
        soft = F.when(s["text"].rlike(r"(?i)\b(?:with|was)\b"), "soft").otherwise("normal")
        return F.struct(X.word_count(s["text"]).alias("words"), s["is_dialogue"].alias("is_dialogue"), F.lit("Narrator").alias("speaker"), X.emotion(s["text"], EMOTIONS).alias("emotion"), soft.alias("emphasis"), s["is_paragraph_start"].alias("starts"))

    by_doc = docs.select("doc_id", F.transform(C.sentence_array(F.col("text"), LINES), told).alias("s"))
    return C.exploded(by_doc, "doc_id", C.group_segments(F.col("s")), "index", "segment")


_PHRASE = lambda key, table: "case " + " ".join(f"when {key} = '{k}' then '{v}'" for k, v in table.items() if v) + " end"


@query(
    "t24_instruction", "events",
    sql=f"""select event_id, concat_ws(' ', {_PHRASE("e", vocab.EMOTION_PHRASES)}, {_PHRASE("m", vocab.EMPHASIS_PHRASES)}, {_PHRASE("p", vocab.PACING_PHRASES)}) as instruction
      from (select event_id, {listed([*vocab.EMOTION_PHRASES, 'unknown'])}[1 + event_id % 10] as e, {listed(vocab.EMPHASIS_PHRASES)}[1 + event_id % 5] as m, {listed(['slow', 'fast', 'urgent', 'normal'])}[1 + event_id % 4] as p from events)""",
)
def _(events):
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    return events.select("event_id", X.instruction(pick([*vocab.EMOTION_PHRASES, "unknown"]), pick(list(vocab.EMPHASIS_PHRASES)), pick(["slow", "fast", "urgent", "normal"])).alias("instruction"))


_CLEAN = f"""
with a as (select doc_id, unnest(regexp_extract_all(text, '[^\\s]+(?:\\s+[A-Z][^\\s]*)?')) as raw from documents),
b as (select doc_id, raw, {strip("regexp_replace(regexp_replace(raw, '^[^a-zA-Z]+', ''), '[^a-zA-Z.\\s''-]+$', '')")} as n from a),
c as (select *, regexp_matches(n, '[.!?;:—–]') and not regexp_matches(n, '^(?:Mr|Mrs|Ms|Dr|St|Jr|Sr)\\.\\s') as pointed from b),
d as (select *, case when pointed then regexp_replace(n, '\\.+$', '') else n end as f,
  length(n) < 2 or regexp_matches(n, '^\\p{{Ll}}') or (length(n) <= 2 and lower(n) in ({', '.join(f"'{w}'" for w in vocab.SHORT_WORDS)})) as bad,
  pointed and (regexp_matches(n, '[.!?][\\s\\-—–]*[A-Z]') or regexp_matches(n, '[—–]|--')) as broken from c)
select doc_id, raw, case when not bad and not broken and length(f) >= 2 and not list_has_any(list_transform({words('lower(f)')}, lambda w: regexp_replace(w, '\\.+$', '')), {listed(vocab.STOP_NAMES)}) then f end as name from d
"""


@query("t25_clean_name", "documents", sql=f"select name, count(*) as n from ({_CLEAN}) group by name")
def _(docs):
    raw = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+(?:\s+[A-Z][^\s]*)?"), 0)).alias("raw"))
    return raw.select(X.clean_name(F.col("raw")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_HON = ("the", "of", "and", "la", "der", "supplier", "customer")


@query(
    "t26_strip_honorifics", "customer",
    sql=f"""select c_custkey, case when len(r) > 0 then array_to_string(r, ' ') else c_name end as name from (select c_custkey, c_name, list_filter({words("replace(c_name, '#', ' ')")}, lambda w: not list_contains({listed(_HON)}, regexp_replace(lower(w), '\\.+$', ''))) as r from customer)""",
)
def _(customer):
    return customer.select("c_custkey", X.strip_honorifics(F.replace("c_name", F.lit("#"), F.lit(" ")), _HON).alias("name"))


@query(
    "t28_json_array", "events",
    sql="""select event_id, case event_id % 4 when 3 then null else '[' || event_id || ', ' || user_id || ']' end as parsed from events""",
)
def _(events):
    body = F.concat(F.lit("["), F.col("event_id"), F.lit(", "), F.col("user_id"), F.lit("]"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked"))).otherwise(F.lit("no array, {}"))
    return events.select("event_id", X.json_array(text).alias("parsed"))


@query(
    "t29_prompt", "conversations",
    sql="""select conv_id, 'Characters in this book: user, assistant' || chr(10) || 'Sentences to analyze:' || chr(10)
      || string_agg('[' || n || '] ' || case when role = 'user' then '[DIALOGUE]' else '[NARRATION]' end || ' "' || text || '"', chr(10) order by n) || chr(10)
      || chr(10) || 'Respond with a JSON array of objects, one per sentence. Each object must have keys: index, speaker, emotion, emphasis, pacing, vocal_direction.' as prompt
      from (select *, row_number() over (partition by conv_id order by turn, text) as n from conversations) group by conv_id""",
)
def _(conv):
    by = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", (F.col("role") == "user").alias("is_dialogue")))).alias("s"))
    return by.select("conv_id", X.prompt(F.array(F.lit("user"), F.lit("assistant")), F.lit(""), F.col("s")).alias("prompt"))


@query("t30_preview", "documents", sql="select doc_id, case when length(text) > 40 then left(text, 40) || '...' else text end as preview from documents")
def _(docs):
    return docs.select("doc_id", X.preview(F.col("text"), 40).alias("preview"))


@query(
    "t31_char_census", "documents",
    sql="select c as ch, unicode(c)::int as code, count(*) as n from (select unnest(string_split(left(text, 3000), '')) as c from documents) where c <> '' and unicode(c) > 127 group by c",
)
def _(docs):
    return X.char_census(docs, "text", 3000).drop("name")


@query("t31_dialogue_samples", "documents", sql="select doc_id, unnest(s) as sample from (select doc_id, (regexp_extract_all(left(text, 3000), '[A-Z][a-z]+ [a-z]+[.!?]'))[1:5] as s from documents)")
def _(docs):
    return docs.select("doc_id", F.explode(X.samples_of(F.col("text"), r"[A-Z][a-z]+ [a-z]+[.!?]", 5, 3000)).alias("sample"))


@query(
    "t32_human_bytes", "documents",
    sql="select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024 * 10 + 0.5::double) / 10) else printf('%.1f MB', floor(n / 1048576 * 10 + 0.5::double) / 10) end as size from (select doc_id, n_chars * (1 + doc_id % 300) as n from documents)",
)
def _(docs):
    return docs.select("doc_id", X.human_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 300)).alias("size"))


@query("y1_utc_attach", "events", sql="select event_id, floor(epoch(ts))::bigint as seconds from events")
def _(events):
    return events.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


# ---- A: parsing --------------------------------------------------------------------------

_HEAD = (r"(?m)^[A-ZÀ-Ý][a-zà-ÿ]+ [a-zà-ÿ]+\b", r"(?m)^[A-ZÀ-Ý][a-zà-ÿ]+\.$")


_A3 = f"""
with recursive l as (select doc_id, unnest(range(len(x))) as i, unnest(x) as line, x from (select doc_id, string_split(text, chr(10)) as x from documents)),
h as (select doc_id, (coalesce(list_sum(list_transform(x[1:i], lambda y: length(y))), 0) + i)::bigint as start, unnest([regexp_extract(line, '^([A-ZÀ-Ý][a-zà-ÿ]+ [a-zà-ÿ]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), regexp_extract(line, '^([A-ZÀ-Ý][a-zà-ÿ]+\\.)$', 1)]) as title, unnest([0, 1]) as o from l),
s as (select *, row_number() over (partition by doc_id order by start, o) as k from h where title <> ''),
f(doc_id, k, last, kept) as (select doc_id, k, start, true from s where k = 1 union all select s.doc_id, s.k, case when s.start - f.last > 200 then s.start else f.last end, s.start - f.last > 200 from f join s on s.doc_id = f.doc_id and s.k = f.k + 1)
select s.doc_id, s.start, s.title from f join s on s.doc_id = f.doc_id and s.k = f.k where kept
"""


@query("a3_chapter_boundaries", "documents", sql=_A3)
def _(docs):
    return C.exploded(C.headings(docs, "doc_id", patterns=_HEAD), "doc_id", C.keep_apart(F.col("found")), "at", "h").select("doc_id", "h.start", "h.title")


@query("a3_boundaries_in_sql", "documents", sql=_A3)
def _(docs):
    """The same through SQL: a table function in a lateral join."""
    spark = docs.sparkSession
    table_functions.register(spark, _HEAD, name="query_headings")
    return spark.sql("select d.doc_id, h.start, h.title from {docs} d, lateral query_headings(d.text) h", docs=docs)


@query(
    "w8_nearby_dedupe", "events",
    sql="""with recursive s as (select user_id, event_id as start, row_number() over (partition by user_id order by event_id) as i from events),
      f(user_id, i, last, kept) as (select user_id, i, start, true from s where i = 1 union all select s.user_id, s.i, case when s.start - f.last > 200 then s.start else f.last end, s.start - f.last > 200 from f join s on s.user_id = f.user_id and s.i = f.i + 1)
      select f.user_id, s.start from f join s on s.user_id = f.user_id and s.i = f.i where kept""",
)
def _(events):
    by = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("start")))).alias("found"))
    return C.exploded(by, "user_id", C.keep_apart(F.col("found")), "at", "h").select("user_id", "h.start")


_A4 = f"""
with b as (select doc_id, start, title, lead(start) over (partition by doc_id order by start) as stop from ({_A3})),
c as (select doc_id, start, title, {strip("text[start + 1:coalesce(stop, length(text))]")} as part from b join documents using (doc_id)),
d as (select doc_id, start, title, {strip("part[length(title) + 1:]")} as text from c),
e as (select * from d where length(text) > 20 union all select doc_id, 0, null, {strip('text')} from documents where doc_id not in (select doc_id from b))
select doc_id, title, text, (row_number() over (partition by doc_id order by start))::int as number from e
"""


@query("a4_chapter_slices", "documents", sql=_A4)
def _(docs):
    return C.split_chapters(docs, "doc_id", patterns=_HEAD)


@query(
    "a7_html_text", "pages",
    sql=f"""select page_id, {strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')")} as text from pages""",
)
def _(pages):
    return pages.select("page_id", X.plain_text(F.col("html")).alias("text"))


@query(
    "a8_html_title", "pages",
    sql=rf"""select page_id, coalesce({', '.join(f"case when length(h{i}) between 1 and 199 then h{i} end" for i in (1, 2, 3))}) as title from (select page_id, {', '.join(strip(f"regexp_replace(regexp_extract(html, '(?is)<h{i}[^>]*>(.*?)</h{i}>', 1), '<[^>]*>', '', 'g')") + f' as h{i}' for i in (1, 2, 3))} from pages)""",
)
def _(pages):
    return pages.select("page_id", X.title_from_html(F.col("html"), F.lit("")).alias("title"))


@query(
    "a9_file_title", "pages",
    sql=r"""select page_id, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') as title from (select page_id, translate(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '_-', '  ') as s from pages)""",
)
def _(pages):
    return pages.select("page_id", X.title_from_file_name(F.col("url")).alias("title"))


@query(
    "a11_chapter_write", "documents",
    sql=f"select source, doc_id, row_number() over (partition by source order by doc_id)::int as number, len({words('text')})::int as word_count from documents",
)
def _(docs):
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs.select("source", "doc_id", F.row_number().over(w).alias("number"), X.word_count(F.col("text")).alias("word_count"))


@query(
    "a15_file_names", "orders",
    sql=r"""select o_orderkey, printf('job_%s_ch%03d_seg%04d.wav', o_orderkey::varchar, o_custkey, o_orderkey % 10000) as segment, regexp_replace(left(regexp_replace(o_orderpriority || '/#' || o_orderkey, '[^\p{L}\p{N} _-]', '', 'g'), 50), '^\s+|\s+$', '', 'g') || '_' || left(o_orderkey::varchar, 8) as title from orders""",
)
def _(orders):
    job = F.col("o_orderkey").cast("string")
    return orders.select("o_orderkey", X.segment_file(job, F.col("o_custkey"), F.col("o_orderkey") % 10000).alias("segment"), X.safe_title(F.concat("o_orderpriority", F.lit("/#"), "o_orderkey"), job).alias("title"))


@query("a7_html_parsed", "pages")
def _(pages):
    from ..sources.books import html_pages

    return html_pages(pages, "page_id")


@query("t27_similarity", "conversations")
def _(conv):
    from ..operators.backends import with_similarity

    heard = conv.select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("heard"))
    return with_similarity(heard, "text", "heard").select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))


@query("s23_synthetic_speech", "conversations", sql=f"select conv_id, turn, floor(100 * greatest(0.3::double, len({words('text')}) / 2.5::double))::int as n from conversations")
def _(conv):
    from ..operators.backends import synthesise, tone

    rows = conv.select("conv_id", "turn", "text", "role", F.lit(42).alias("seed"))
    return synthesise(rows, "text", "role", "seed", tone(100)).select("conv_id", "turn", F.size("samples").alias("n"))
