"""Characters of a book: mentions, counts, consolidation of names, roles, genders, voices."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vocab
from ..functions.audio import let
from ..scratch import materialise
from .graphs import components

Recogniser = Callable[[], Callable[[str], Sequence[tuple[str, str]]]]


def raw_mentions(chapters: DataFrame, book: str, chapter: str, text: str = "text", pattern: str = vocab.NAME_PATTERN) -> DataFrame:
    """book, chapter, at, raw: capitalised runs (the default entity recogniser)."""
    return chapters.select(book, chapter, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("at", "raw"))


def raw_entities(chapters: DataFrame, book: str, chapter: str, load: Recogniser, text: str = "text") -> DataFrame:
    """book, chapter, at, raw, label by a pluggable recogniser, loaded once for each task.

    ``load`` gives a function from a text to (entity, label) pairs; label PERSON marks persons,
    any other label names that ``drop_non_persons`` takes as tagged otherwise.
    """
    kind = pa.list_(pa.struct([("raw", pa.string()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognise = load()
        for batch in batches:
            found = [[{"raw": raw, "label": label} for raw, label in recognise(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["book"], batch["chapter"], pa.array(found, kind)], ["book", "chapter", "found"])

    rows = chapters.select(F.col(book).alias("book"), F.col(chapter).alias("chapter"), F.col(text).alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("book", "chapter")}
    out = rows.mapInArrow(run, f"book {kinds['book']}, chapter {kinds['chapter']}, found array<struct<raw:string,label:string>>")
    return out.select(F.col("book").alias(book), F.col("chapter").alias(chapter), F.posexplode("found").alias("at", "f")).select(book, chapter, "at", "f.*")


def cleaned(found: DataFrame) -> DataFrame:
    """Raw mentions with their cleaned name in place of ``raw``; what cannot be a name goes."""
    return found.select(*(X.clean_name(F.col(c)).alias("name") if c == "raw" else c for c in found.columns)).where("name is not null")


def mentions(chapters: DataFrame, book: str, chapter: str, text: str = "text", pattern: str = vocab.NAME_PATTERN) -> DataFrame:
    """book, chapter, at, name: cleaned names of capitalised runs."""
    return cleaned(raw_mentions(chapters, book, chapter, text, pattern))


def entities(chapters: DataFrame, book: str, chapter: str, load: Recogniser, text: str = "text") -> DataFrame:
    """book, chapter, at, name, label: cleaned names by a pluggable recogniser."""
    return cleaned(raw_entities(chapters, book, chapter, load, text))


def name_counts(found: DataFrame, book: str, chapter: str, *by: str) -> DataFrame:
    """book, name, ``by``, n, first_chapter, first_seen of raw mentions.

    Mentions are combined before the shuffle, and each distinct form of a book is cleaned once.
    """
    forms = found.groupBy(book, "raw", *by).agg(F.count("*").alias("n"), F.min(F.struct(F.col(chapter).alias("c"), F.col("at").alias("a"))).alias("seen"))
    named = forms.withColumn("name", X.clean_name(F.col("raw"))).where("name is not null")
    return named.groupBy(book, "name", *by).agg(F.sum("n").alias("n"), F.min("seen.c").alias("first_chapter"), F.min("seen").alias("first_seen"))


def drop_non_persons(counts: DataFrame, non_persons: DataFrame, keep_from: int = 20, by: Sequence[str] = (), known: Sequence[str] = vocab.KNOWN_NON_CHARACTERS) -> DataFrame:
    """Without ``known`` places and peoples; names tagged otherwise stay only if frequent.

    ``non_persons``: name_lower and, if tags hold for one book only, the columns ``by``.
    """
    tagged = non_persons.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("name_lower").alias("_n")).distinct()
    rows = (counts.where(~X.is_non_character(F.col("name"), known)) if known else counts).withColumn("_k", F.lower("name"))
    same = (F.col("_k") == F.col("_n")) & (F.col("n") < keep_from)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(tagged, same, "left_anti").drop("_k")


def top_then_having(counts: DataFrame, book: str, k: int = 30, least: int = 3) -> DataFrame:
    """The ``k`` most frequent names of each book, then those with ``least`` mentions."""
    w = Window.partitionBy(book).orderBy(F.desc("n"), "first_seen", "name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("n") >= least)


def merge_cores(cores: Sequence[tuple[str, int]]) -> list[int]:
    """Group number of each core name; ``cores`` (lower-case name, count) come by falling count.

    An unused core seeds a group; the group takes an unused core that shares a word of three
    letters with it if that core is one word or one word set holds the other, until none fits.
    The order matters: this is no connected component.  Cores are found by their words, so a
    group looks at those that share a word with it and at no others.
    """
    words = [set(c.split()) for c, _ in cores]
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(words):
        for w in own:
            if len(w) >= 3:
                holders.setdefault(w, []).append(i)
    group = [-1] * len(cores)
    for seed in range(len(cores)):
        if group[seed] >= 0:
            continue
        group[seed] = seed
        own, known, grew = set(words[seed]), set(), True
        while grew:  # one pass over the candidates in order; words that join add candidates ahead, or for the next pass
            grew = False
            known = {i for i in known if group[i] < 0} | {i for w in own if len(w) >= 3 for i in holders[w] if group[i] < 0}
            ahead = sorted(known)
            heapq.heapify(ahead)
            while ahead:
                i = heapq.heappop(ahead)
                other = words[i]
                if group[i] < 0 and (len(other) == 1 or other <= own or own <= other):
                    group[i] = seed
                    grew = True
                    for w in other - own:
                        for j in holders.get(w, ()) if len(w) >= 3 else ():
                            if j > i and group[j] < 0 and j not in known:
                                heapq.heappush(ahead, j)
                                known.add(j)
                    own |= other
    return group


def with_core(counts: DataFrame, honorifics: Sequence[str] = vocab.HONORIFICS) -> DataFrame:
    """``counts`` with bare (the name without honorifics) and core (in lower case)."""
    bare = X.strip_honorifics(F.col("name"), honorifics)
    return counts.withColumn("bare", bare).withColumn("core", F.lower("bare"))


def related(cores: DataFrame, book: str) -> DataFrame:
    """``cores`` (book, core) with part: the cores of a book that words of three letters link, directly or through others.

    Greedy merging never leaves such a part, so parts merge apart from each other.
    """
    hashes = F.transform(F.filter(X.words(F.col("core")), lambda w: F.char_length(w) >= 3), lambda w: F.xxhash64(F.col(book), w))
    keyed = cores.withColumn("_words", hashes).withColumn("_node", F.array_min("_words"))
    labels = components(keyed.select(F.col("_node").alias("a"), F.explode("_words").alias("b")).distinct())
    both = keyed.join(labels, F.col("_node") == F.col("node"), "left")
    return both.withColumn("part", F.coalesce("label", F.xxhash64(F.col(book), F.lit(" "), F.col("core")))).drop("_words", "_node", "node", "label")


def consolidate(counts: DataFrame, book: str, honorifics: Sequence[str] = vocab.HONORIFICS) -> DataFrame:
    """``counts`` (book, name, n, first_chapter, first_seen) with bare, core, grp and ord: forms of one character share ``grp``.

    Forms group by core; cores merge within the parts of ``related``, each walked in its task
    in the order of the book.  ``ord`` orders groups: by their seeds' falling count, then first place.
    """
    cored = materialise(with_core(counts, honorifics))  # read twice: for the cores and for their forms
    cores = cored.groupBy(book, "core").agg(F.sum("n").alias("total"), F.min("first_seen").alias("seen"))
    rows = related(cores, book).select("part", F.col(book).alias("book"), "core", (-F.col("total")).alias("less"), F.col("seen.c").alias("c"), F.col("seen.a").alias("a"))
    order = ["less", "c", "a", "core"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("book", *order)}

    def merged(table: pa.Table) -> pa.RecordBatch:
        part = table["part"].to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        cores, less = table["core"].to_pylist(), table["less"].to_pylist()
        seeds = [a + g for a, b in zip(cuts, cuts[1:]) for g in merge_cores([(c, -n) for c, n in zip(cores[a:b], less[a:b], strict=True)])]
        own = table.select(["book", "core"]).combine_chunks()
        seed = table.select(order).take(pa.array(seeds, pa.int64())).combine_chunks()
        return pa.Table.from_arrays([*own.columns, *seed.columns], ["book", "of", *order]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            part = table["part"].to_numpy()
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            held = table.slice(cut)
            if cut:
                yield merged(table.slice(0, cut))
        if held is not None:
            yield merged(held)

    ordered = rows.repartition("part").sortWithinPartitions("part", *order)
    walked = ordered.mapInArrow(run, f"book {kinds['book']}, of string, " + ", ".join(f"{c} {kinds[c]}" for c in order))
    groups = walked.select(F.col("book").alias(book), F.col("of").alias("core"), F.col("core").alias("grp"), F.struct(*order).alias("ord"))
    return cored.join(groups, [book, "core"])


def canonical(grouped: DataFrame, book: str) -> DataFrame:
    """book, grp, ord, canonical, aliases, n, first_chapter: one row for each canonical name.

    canonical is the longest form without its honorifics, then that of the most frequent form,
    then of the first seen.  Of groups with equal canonical names the last one stays.
    """
    bare = F.col("bare")
    best = F.struct(F.char_length(bare).alias("l"), F.col("n").alias("n"), (-F.col("first_seen.c")).alias("c"), (-F.col("first_seen.a")).alias("a"), F.col("name").alias("z"))
    out = grouped.groupBy(book, "grp", "ord").agg(F.max_by(bare, best).alias("canonical"), F.sort_array(F.collect_set("name")).alias("forms"), F.sum("n").alias("n"), F.min("first_chapter").alias("first_chapter"))
    rows = F.struct("ord", "grp", F.array_remove("forms", F.col("canonical")).alias("aliases"), "n", "first_chapter")
    last = out.groupBy(book, "canonical").agg(F.max_by(rows, "ord").alias("r"))
    return last.select(book, "r.grp", "r.ord", "canonical", "r.aliases", "r.n", "r.first_chapter")


def attributions(texts: DataFrame, key: str, text: str = "text", verbs: Sequence[str] = vocab.ATTRIBUTION_VERBS) -> DataFrame:
    """key, start, pattern, speaker: every match of the three forms of a quote with a named speaker.

    Two forms may match at one start; which one counts is decided once speakers are resolved.
    """
    patterns = [re.compile(p.replace("VERB", "|".join(verbs))) for p in vocab.ATTRIBUTION_PATTERNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"start": m.start(), "pattern": i, "speaker": m.group(1).strip()} for i, p in enumerate(patterns) for m in p.finditer(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, kind)], ["key", "found"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("pattern", pa.int32()), ("speaker", pa.string())]))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, found array<struct<start:long,pattern:int,speaker:string>>")
    return out.select(F.col("key").alias(key), F.explode("found").alias("f")).select(key, "f.*")


def dialogue_counts(found: DataFrame, names: DataFrame, scope: Sequence[str], place: Sequence[str]) -> DataFrame:
    """scope, id, dialogue: quotes of each character; ``found`` has scope, place, start, pattern and speaker.

    A start belongs to the first pattern whose speaker is a known character; a match that
    resolves to nobody leaves it to the later ones.
    """
    spoken = resolve(found, names, scope).where("character is not null")
    one = spoken.groupBy(*scope, *(c for c in place if c not in scope), "start").agg(F.min_by("character", "pattern").alias("id"))
    return one.groupBy(*scope, "id").agg(F.count("*").alias("dialogue"))


def resolve(references: DataFrame, names: DataFrame, scope: Sequence[str], spoken: str = "speaker") -> DataFrame:
    """``references`` with character: the whole name, else the first of its words of three letters that a name holds.

    ``names``: scope, id, ord, name, aliases.  Full names and aliases win over parts of names;
    of equal keys the last full name or alias and the first part count.
    """
    full = names.select(*scope, "id", "ord", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_key")).select(*scope, "id", F.lower("_key").alias("_key"), F.lit(0).alias("_kind"), (-F.col("ord")).alias("_o"))
    part = names.select(*scope, "id", "ord", F.explode(X.words(F.col("name"))).alias("_key")).where(F.char_length("_key") >= 3).select(*scope, "id", F.lower("_key").alias("_key"), F.lit(1).alias("_kind"), F.col("ord").alias("_o"))
    keys = full.unionByName(part).groupBy(*scope, "_key").agg(F.min_by("id", F.struct("_kind", "_o", "id")).alias("_id"))
    asked = references.select(*(F.col(c).alias(f"_{c}") for c in scope), F.col(spoken).alias("_said")).distinct()
    whole = F.lower(X.strip_honorifics(F.col("_said")))
    tries = F.concat(F.array(F.struct(F.lit(-1).alias("at"), whole.alias("k"))), F.filter(F.transform(X.words(whole), lambda w, i: F.struct(i.alias("at"), w.alias("k"))), lambda x: F.char_length(x["k"]) >= 3))
    own = [f"_{c}" for c in scope]
    tried = asked.select(*own, "_said", F.explode(tries).alias("_t")).select(*own, "_said", F.col("_t.at").alias("_at"), F.col("_t.k").alias("_key"))
    hits = tried.join(keys.withColumnsRenamed({c: f"_{c}" for c in scope}), [*own, "_key"]).groupBy(*own, "_said").agg(F.min_by("_id", "_at").alias("character"))
    same = F.col(spoken) == F.col("_said")
    for c in scope:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return references.join(hits, same, "left").drop(*own, "_said")


def _starts(text: str, name: str) -> list[int]:
    """Every place of ``name`` in ``text``, overlapping ones too."""
    found, at = [], text.find(name)
    while at >= 0:
        found.append(at)
        at = text.find(name, at + 1)
    return found


def _near(starts: Sequence[int], ends: Sequence[int], others: Sequence[int], other_ends: Sequence[int], window: int) -> int:
    """Non-overlapping matches of one of ``starts`` up to the farthest of ``others`` within ``window`` after its end.

    Both lists ascend; a match ends with its farthest partner, and the next one begins there or later.
    """
    count = at = i = 0
    while (i := bisect_left(starts, at, i)) < len(starts):
        far = bisect_right(others, ends[i] + window) - 1
        if far >= 0 and others[far] >= ends[i]:
            count, at = count + 1, other_ends[far]
        else:
            i += 1
    return count


def near_counts(names: Sequence[str], text: str, pronouns: Sequence[Sequence[str]], window: int = 300) -> list[list[int]]:
    """For each name, its matches with each set of pronouns, name first and pronoun first together.

    The text is read once for the pronouns and searched once for each name: positions meet, no
    pattern spans the window.
    """
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer keep their places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    sets = {p: i for i, own in enumerate(pronouns) for p in own}
    places: list[tuple[list[int], list[int]]] = [([], []) for _ in pronouns]
    for m in re.finditer(rf"\b(?:{'|'.join(sets)})\b", low):
        starts, ends = places[sets[m.group()]]
        starts.append(m.start())
        ends.append(m.end())
    out = []
    for name in names:
        own = _starts(low, name.lower()) if name else []
        own_ends = [x + len(name) for x in own]
        out.append([_near(own, own_ends, *p, window) + _near(*p, own, own_ends, window) for p in places])
    return out


PRONOUNS = (("he", "him", "his"), ("she", "her", "hers"))


def pronoun_hits(names: Column, text: Column, window: int = 300, sample: int = 500_000) -> Column:
    """array<struct(male, female)>: for each of ``names``, its matches near pronouns in the opening of ``text``, whatever the case."""
    kind = pa.list_(pa.struct([("male", pa.int32()), ("female", pa.int32())]))

    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(names.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([[{"male": m, "female": f} for m, f in near_counts([n or "" for n in own or ()], t or "", PRONOUNS, window)] for own, t in rows], kind)

    run.__annotations__ = {"names": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<male:int,female:int>>")(names, F.left(text, F.lit(sample)))


def gender(name: Column, text: Column) -> Column:
    """By first name, else by the pronouns near the name in the opening of ``text``."""
    by_text = let(F.get(pronoun_hits(F.array(name), text), F.lit(0)), lambda h: X.gender_by_pronouns(h["male"], h["female"]))
    return F.coalesce(X.gender_by_name(name), by_text)


def speakers(characters: DataFrame, book: str, order: str, gender: str = "gender") -> DataFrame:
    """``characters`` with voice: men and women take turns in their lists, others in both; an unknown also counts as a man."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    women = F.coalesce(F.sum(F.when(F.col(gender) == "female", 1).otherwise(0)).over(w), F.lit(0))
    before = F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))
    men, fem, both = (F.array(*map(F.lit, x)) for x in (vocab.MALE_VOICES, vocab.FEMALE_VOICES, (*vocab.MALE_VOICES, *vocab.FEMALE_VOICES)))
    pick = lambda a, i, n: F.get(a, (i % n).cast("int"))
    voice = F.when(F.col(gender) == "female", pick(fem, women, 2)).when(F.col(gender) == "male", pick(men, before - women, 2)).otherwise(pick(both, before, 4))
    return characters.withColumn("voice", voice)


def _pitch(gender: str) -> Column:
    return F.when(F.col(gender) == "male", -2.0).when(F.col(gender) == "female", 2.0).otherwise(0.0)


def voice_profiles(characters: DataFrame, book: str, order: str) -> DataFrame:
    """``characters`` (role, gender) with seed, temperature, speaking_rate and pitch_shift of their new voices."""
    i = F.row_number().over(Window.partitionBy(book).orderBy(order)) - 1
    return characters.select("*", (42 + i).alias("seed"), F.when(F.col("role") == "protagonist", 0.6).otherwise(0.7).alias("temperature"), F.lit(1.0).alias("speaking_rate"), _pitch("gender").alias("pitch_shift"))


def trait_profiles(characters: DataFrame, book: str, order: str, profile: str = "voice_profile_id") -> DataFrame:
    """Profiles by role, age and gender for the characters that have none; seeds count all characters."""
    i = F.row_number().over(Window.partitionBy(book).orderBy(order)) - 1
    rows = characters.select(
        "*", (42 + i).alias("seed"), F.when(F.col("role") == "protagonist", 0.6).when(F.col("role") == "supporting", 0.65).otherwise(0.7).alias("temperature"),
        F.when(F.col("age") == "elderly", 0.9).when(F.col("age") == "child", 1.1).otherwise(1.0).alias("speaking_rate"), _pitch("gender").alias("pitch_shift"),
    )
    return rows.where(F.col(profile).isNull())


def character_table(chapters: DataFrame, book: str, chapter: str, text: str = "text", load: Recogniser | None = None, non_persons: DataFrame | None = None, verbs: Sequence[str] = vocab.ATTRIBUTION_VERBS, k: int = 30, least: int = 3, keep_from: int = 20) -> DataFrame:
    """book, rank, name, aliases, n, dialogue, role, gender, first_chapter of each book's characters.

    Entities are counted, non-persons dropped, names merged, dialogue counted, and only then
    the ``k`` most frequent of each book taken and of these those with ``least`` mentions.
    Gender is by first name, else by pronouns near the name in the first 500,000 characters of
    the book (chapters joined by blank lines).  ``load``: a recogniser; by default
    capitalised runs, with ``non_persons`` (name_lower) as the names tagged otherwise.
    """
    if load is None:
        counts = name_counts(raw_mentions(chapters, book, chapter, text), book, chapter)
    else:
        every = materialise(name_counts(raw_entities(chapters, book, chapter, load, text), book, chapter, "label"))
        counts = every.where("label = 'PERSON'").drop("label")
        non_persons = every.where("label <> 'PERSON'").select(book, F.lower("name").alias("name_lower"))
    if non_persons is not None:
        counts = drop_non_persons(counts, non_persons, keep_from, [book] if load else ())
    else:
        counts = counts.where(~X.is_non_character(F.col("name")))
    order = Window.partitionBy(book).orderBy("ord")
    merged = materialise(canonical(consolidate(counts, book), book).withColumn("ord", F.row_number().over(order)))
    names = merged.select(book, F.col("canonical").alias("id"), F.col("ord"), F.col("canonical").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    spoken = attributions(chapters.select(F.struct(book, chapter).alias("_at"), text), "_at", text, verbs).select(f"_at.{book}", f"_at.{chapter}", "start", "pattern", "speaker")
    dialogue = dialogue_counts(spoken, names, [book], [book, chapter]).withColumnRenamed("id", "canonical")
    ranked = Window.partitionBy(book).orderBy(F.desc("n"), "ord")
    top = merged.withColumn("rank", F.row_number().over(ranked)).where((F.col("rank") <= k) & (F.col("n") >= least)).join(dialogue, [book, "canonical"], "left").withColumn("dialogue", F.coalesce("dialogue", F.lit(0)))
    hits = near_pronouns(chapters, top.where(X.gender_by_name(F.col("canonical")).isNull()).select(book, "canonical"), book, chapter, text)
    both = top.join(hits, [book, "canonical"], "left")
    by_text = X.gender_by_pronouns(F.coalesce("male", F.lit(0)), F.coalesce("female", F.lit(0)))
    return both.select(book, "rank", F.col("canonical").alias("name"), "aliases", "n", "dialogue", X.role(F.col("n"), F.col("dialogue")).alias("role"), F.coalesce(X.gender_by_name(F.col("canonical")), by_text).alias("gender"), "first_chapter")


def near_pronouns(chapters: DataFrame, names: DataFrame, book: str, chapter: str, text: str = "text", sample: int = 500_000) -> DataFrame:
    """book, canonical, male, female: matches of each name near pronouns in the opening of its book.

    The opening is the first ``sample`` characters of the chapters joined by blank lines: at
    most that much text meets for a book, whatever its size; what lies beyond is cut first, and
    it is one row with the book's names, of which ``character_table`` asks for the top few.
    """
    before = Window.partitionBy(book).orderBy(chapter).rowsBetween(Window.unboundedPreceding, -1)
    sized = chapters.select(book, chapter, F.col(text).alias("_t"), F.char_length(F.coalesce(text, F.lit(""))).alias("_n"))
    placed = sized.select(book, chapter, "_n").withColumn("_from", F.coalesce(F.sum(F.col("_n") + 2).over(before), F.lit(0)))
    needed = placed.where(F.col("_from") < sample).select(F.col(book).alias("_b"), F.col(chapter).alias("_c"), "_from")
    parts = sized.join(needed, (F.col(book) == F.col("_b")) & (F.col(chapter) == F.col("_c"))).select(book, "_from", F.left("_t", (sample - F.col("_from")).cast("int")).alias("_t"))
    opening = parts.groupBy(book).agg(F.left(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_from", "_t"))), lambda x: x["_t"]), "\n\n"), F.lit(sample)).alias("_head"))
    asked = names.groupBy(book).agg(F.sort_array(F.collect_list("canonical")).alias("_names")).join(opening, book)
    counted = asked.select(book, F.explode(F.arrays_zip("_names", pronoun_hits(F.col("_names"), F.col("_head"), sample=sample).alias("_hits"))).alias("_x"))
    return counted.select(book, F.col("_x._names").alias("canonical"), F.col("_x._hits.male").alias("male"), F.col("_x._hits.female").alias("female"))
