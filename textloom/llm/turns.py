"""Speech transcripts into clean, ordered speaker turns, by SQL expressions and windows.

Labels are found by a pattern that each track's cast gives, so a name in the text is no label and "Chapter 3:" is no name;
marked noise (sound notes, time codes) is removed; what is left is cut at the labels. Speakers are filled forward, a bare
change mark switches between the two speakers of a cast, and turns are the islands of equal speakers. All windows run
over blocks of a track; one row for each block then carries the speaker, the switches and the number of turns on from
block to block, so no task holds a whole track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import cut_lineage

#: Positions of a track in a block.
BLOCK = 1024

# Hesitation and listening sounds, time codes and marked noise, as patterns.
SOUNDS = r"(?iu)(?<![\p{L}\p{N}])(?:uh-?huh|u+h+m*|u+m+|a+h+a+|mm-?hm+|e+r+m*|h+m+|m+-?h+m+|m{2,}|eh+m?|em|este|ä+h+m?|euh+|heu|hum|né|ahn|э+-?э*|э+м+|м{2,}|гм|угу|嗯+|呃+|えー+と?|えっと|ええと|うーん|あのー*)(?![\p{L}\p{N}]|-\p{L})"
TIME_CODES = r"[\[({<]\s*(?:\d{1,3}:)?\d{1,3}:\d{2}(?:[.,]\d+)?\s*[\])}>]|(?<![\d:])\d{1,3}:\d{2}:\d{2}(?:[.,]\d+)?(?![\d:])"
CLOCK = r"(?<![\d:])\d{1,3}:\d{2}(?:[.,]\d+)?(?![\d:])"
NOISE = r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|【[^】]*】|（[^）]*）|\*[^*\n]+\*|[♪♫]+[^♪♫\n]*[♪♫]+|[♪♫]|</?[A-Za-z][^>]*>"

_L, _R = "\x01", "\x02"


def _quoted(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"([^\p{L}\p{N} ])", r"\\$1")


def casts(speakers: DataFrame, track: str, number: str, name: str, role: str) -> DataFrame:
    """``track, cast, forms``: the speakers of each track and the pattern of all forms of their names.

    A cast is the people of one recording; speakers without a number or a name are left out, and a speaker stored twice
    is one.
    """
    full = F.trim(F.regexp_replace(F.col(name), r"\s+", " "))
    words = F.split(full, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    one = speakers.where(F.col(track).isNotNull() & F.col(number).isNotNull() & (full != "")).select(
        F.col(track).alias("track"),
        F.struct(F.col(number).cast("long").alias("no"), F.lower(full).alias("full"), F.lower(first).alias("first"), F.lower(last).alias("last"), F.lower(F.trim(F.col(role))).alias("role")).alias("s"),
    )
    cast = one.groupBy("track").agg(F.sort_array(F.collect_set("s")).alias("cast"))

    def forms(s: Column) -> Column:
        initial = F.substring(s["last"], 1, 1)
        return F.filter(
            F.array(
                _quoted(s["full"]),
                F.concat(_quoted(s["first"]), F.lit(" "), initial, F.lit(r"\.?")),
                F.concat(F.substring(s["first"], 1, 1), F.lit(r"\.\s?"), initial, F.lit(r"\.")),
                _quoted(s["first"]),
                _quoted(s["last"]),
                F.when(F.length(s["role"]) > 0, _quoted(s["role"])),
                F.concat(F.lit(r"(?:speaker|spk)[ _]?0*"), s["no"].cast("string")),
            ),
            lambda x: x.isNotNull(),
        )

    return cast.select("track", "cast", F.concat_ws("|", F.flatten(F.transform("cast", forms))).alias("forms"))


def mark_labels(text: Column, forms: Column) -> Column:
    """``text`` without marked noise, each label as ``\\x01label\\x02``.

    ``~`` and ``?`` before a label mark a word that may be a misspelt name (with a colon, in brackets); ``>>`` is a change
    of speaker without a name.
    """
    t = F.regexp_replace(F.regexp_replace(text, "[\x01\x02]", " "), TIME_CODES, " ")
    t = F.regexp_replace(t, F.concat(F.lit(r"(?iu)<v[ .]*\s*("), forms, F.lit(r")\s*>")), F.lit(f"{_L}$1{_R}"))
    t = F.regexp_replace(t, F.concat(F.lit(r"(?iu)[\[(]\s*("), forms, F.lit(r")\s*:?\s*[\])]\s*:?")), F.lit(f"{_L}$1{_R}"))
    t = F.regexp_replace(t, r"[\[(]([\p{L}]{3,})[\])]", f"{_L}?$1{_R}")
    t = F.regexp_replace(t, NOISE, " ")
    t = F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_.])("), forms, F.lit(r")\s?:(?=\s|$)")), F.lit(f"{_L}$1{_R}"))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([\p{L}]{3,})\s?:(?=\s|$)", f"{_L}~$1{_R}")
    t = F.regexp_replace(t, rf"(?:>>+|&gt;&gt;)\s*(?={_L}[^?])", " ")
    return F.regexp_replace(t, r">>+|&gt;&gt;", f"{_L}>>{_R}")


def _number(label: Column, cast: Column) -> Column:
    """The number of the speaker a label names; null if none or more than one."""
    guess = label.rlike("^[~?]")
    plain = F.lower(F.regexp_replace(F.trim(F.regexp_replace(label, "^[~?]", "")), r"\s+", " "))

    def named(s: Column) -> Column:
        initial, head = F.substring(s["last"], 1, 1), F.substring(s["first"], 1, 1)
        return (
            (plain == s["full"])
            | (plain == s["first"])
            | (plain == s["last"])
            | F.coalesce(plain == s["role"], F.lit(False))
            | (F.regexp_replace(plain, r"[. ]", "") == F.concat(s["first"], initial))
            | (F.regexp_replace(plain, r"[. ]", "") == F.concat(head, initial)) & plain.contains(".")
            | F.regexp_like(plain, F.concat(F.lit("^(?:speaker|spk)[ _]?0*"), s["no"].cast("string"), F.lit("$")))
        )

    def near(s: Column) -> Column:
        return (F.levenshtein(plain, s["first"]) <= 1) | (F.levenshtein(plain, s["last"]) <= 1)

    found = F.transform(F.filter(cast, named), lambda s: s["no"])
    close = F.transform(F.filter(cast, near), lambda s: s["no"])
    return F.when(label.isNull(), None).when(F.size(found) == 1, F.element_at(found, 1)).when(guess & (F.size(found) == 0) & (F.size(close) == 1), F.element_at(close, 1))


def _pieces(rows: DataFrame, cast: DataFrame, track: str, pos: str, key: str, text: str, start: str, duration: str) -> DataFrame:
    """``track, pos, i, speaker, switch, words, text, start, duration, block``: the rows cut at their labels."""
    one = rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull()).groupBy(F.col(track).alias("track"), F.col(pos).cast("long").alias("pos"))
    one = one.agg(F.min_by(F.struct(F.col(text).alias("text"), F.col(start).alias("start"), F.col(duration).alias("duration")), F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))).alias("r")).select("track", "pos", "r.*")
    with_cast = one.join(cast, "track")
    parts = with_cast.select("track", "pos", "cast", "start", "duration", F.posexplode(F.split(mark_labels(F.coalesce("text", F.lit("")), F.col("forms")), _L)).alias("i", "part"))
    label = F.when(F.col("part").contains(_R), F.substring_index("part", _R, 1))
    body = F.when(F.col("part").contains(_R), F.expr(f"substring(part, instr(part, '{_R}') + 1)")).otherwise(F.col("part"))
    named = parts.withColumns({"label": label, "body": body}).withColumn("speaker", _number(F.col("label"), F.col("cast")))
    # A word with a colon that is no name is spoken; one in brackets that is none is a sound note.
    spoken = F.when(F.col("speaker").isNull() & F.col("label").startswith("~"), F.concat(F.substring("label", 2, 1000), F.lit(": "), F.col("body"))).otherwise(F.col("body"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(spoken, SOUNDS + r"[,…]?(?:\.\.\.)?", " "), r"(?i)(?<![\p{L}])(?:you know|I mean),\s", ""), r"\s+", " "))
    return named.select(
        "track",
        "pos",
        "i",
        "speaker",
        F.coalesce(F.col("label") == ">>", F.lit(False)).cast("int").alias("switch"),
        F.regexp_replace(clean, CLOCK, " ").rlike(r"[\p{L}\p{N}]").alias("words"),
        clean.alias("text"),
        "start",
        "duration",
        F.floor(F.col("pos") / BLOCK).alias("block"),
        F.when(F.size("cast") == 2, F.transform("cast", lambda s: s["no"])).alias("two"),
    )


def _filled(pieces: DataFrame) -> DataFrame:
    """The pieces with words, each with its speaker."""
    local = Window.partitionBy("track", "block").orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, 0)
    p = pieces.withColumn("c", F.sum("switch").over(local))
    p = p.withColumn("named", F.last(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "c")), ignorenulls=True).over(local))
    whole = p.groupBy("track", "block").agg(F.max("c").alias("switches"), F.max_by("named", F.struct("pos", "i")).alias("named"))
    earlier = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumn("before", F.coalesce(F.sum("switches").over(earlier), F.lit(0)))
    carried = carried.withColumn("known", F.last(F.when(F.col("named").isNotNull(), F.struct(F.col("named.speaker").alias("speaker"), (F.col("named.c") + F.col("before")).alias("c"))), ignorenulls=True).over(earlier))
    joined = p.join(carried.select("track", "block", "before", "known"), ["track", "block"])
    base = F.coalesce("named.speaker", "known.speaker")
    odd = (F.when(F.col("named").isNotNull(), F.col("c") - F.col("named.c")).otherwise(F.col("c") + F.col("before") - F.col("known.c")) % 2) == 1
    any_switch = F.when(F.col("named").isNotNull(), F.col("c") > F.col("named.c")).otherwise(F.col("c") + F.col("before") > F.col("known.c"))
    other = F.when(F.element_at("two", 1) == base, F.element_at("two", 2)).otherwise(F.element_at("two", 1))
    speaker = F.when(F.col("two").isNull() & any_switch, None).when(F.coalesce(odd, F.lit(False)), other).otherwise(base)
    return joined.where("words").select("track", "block", "pos", "i", speaker.alias("speaker"), "text", "start", "duration")


def speaker_turns(rows: DataFrame, speakers: DataFrame, track: str = "track_id", pos: str = "pos", key: str = "row_id", text: str = "text", start: str = "start_s", duration: str = "duration_s", number: str = "speaker_no", name: str = "full_name", role: str = "speaker_role", with_text: bool = True) -> DataFrame:
    """``track, turn_no, speaker_no, first_pos, last_pos, start_s, duration_s, text``: the turns of each track in order.

    Rows with the same track and position are one (the first key counts). A turn without spoken words is dropped, and
    turns of one speaker that then follow each other are one; what is spoken before any label, or after a bare change
    mark among more than two speakers, has a null speaker. Tracks without a cast, and rows without a track or position,
    have no turns. Null times are passed over; a turn lasts to the latest end of its rows, and one without times lasts 0.
    """
    pieces = _pieces(rows, casts(speakers, track, number, name, role), track, pos, key, text, start, duration)
    # The pieces are joined with an aggregate of themselves; written once, the rows are read and their patterns run once.
    pieces = cut_lineage(pieces if with_text else pieces.withColumn("text", F.lit(None).cast("string")))
    spoken = cut_lineage(_filled(pieces))
    ordered = Window.partitionBy("track", "block").orderBy("pos", "i")
    local = spoken.withColumns({"prev": F.lag(F.struct("speaker")).over(ordered)})
    whole = spoken.groupBy("track", "block").agg(F.max_by(F.struct("speaker"), F.struct("pos", "i")).alias("last"))
    carried = whole.withColumn("left", F.lag("last").over(Window.partitionBy("track").orderBy("block"))).select("track", "block", "left")
    begun = local.join(carried, ["track", "block"]).withColumn("prev", F.coalesce("prev", "left"))
    begun = begun.withColumn("starts", (F.col("prev").isNull() | ~F.col("prev.speaker").eqNullSafe(F.col("speaker"))).cast("int"))
    begun = begun.withColumn("n", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    counts = begun.groupBy("track", "block").agg(F.max("n").alias("m"))
    counts = counts.select("track", "block", F.coalesce(F.sum("m").over(Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = begun.join(counts, ["track", "block"]).withColumn("turn_no", F.col("n") + F.col("offset"))
    first = F.round(F.min("start"), 3)
    aggs = [F.first("speaker").alias("speaker_no"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), first.alias("start_s"), F.round(F.greatest(F.max(F.col("start") + F.coalesce("duration", F.lit(0.0))) - F.min("start"), F.lit(0.0)), 3).alias("duration_s")]
    if with_text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "text"))), lambda x: x["text"]), " ").alias("text"))
    return numbered.groupBy("track", "turn_no").agg(*aggs)
