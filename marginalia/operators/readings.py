"""Readings as token strings: the tokens' machine as windows, voices merged into chords, and the lines that voices go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import diatonic
from ..functions.notation import lookup, meter, pitch_name

#: Ticks of a whole note here: note values down to a 64th with four dots, in tuplets of 3, 5, 6, 7, 9, 10, 11, 12 and 13.
WHOLE = 2**10 * 3**2 * 5 * 7 * 11 * 13
#: Note values by their token as 64ths of a whole, and those written otherwise where events are compared.
SIXTY_FOURTHS = {"breve": 128, "whole": 64, "half": 32, "quarter": 16, "eighth": 8, "16th": 4, "32nd": 2, "64th": 1}
COMPARED = {"eighth": "8th"}
#: Tokens of accidentals, and the pitch on the middle line by clef.
ACCIDENTALS = ("sharp", "flat", "natural", "double-sharp", "flat-flat", "natural-sharp", "natural-flat")
MIDDLE = {
    "G1": "D5", "G2": "B4", "G3": "G4", "G4": "E4", "G5": "C4", "F1": "C4", "F2": "A3", "F3": "F3", "F4": "D3", "F5": "B2",
    "C1": "G4", "C2": "E4", "C3": "C4", "C4": "A3", "C5": "F3",
}


def ticks(dur: Column, dots: Column) -> Column:
    """Ticks of a note value token with dots; 0 for an unknown or missing one."""
    unit = F.coalesce(lookup(SIXTY_FOURTHS, dur), F.lit(0)) * (WHOLE // 64)
    return (unit * 2 - F.floor(unit / F.pow(F.lit(2), F.coalesce(dots, F.lit(0))))).cast("long")


#: A token that begins an event.
HEAD = r"(?:[A-G][0-9]|rest)(?!\S)"


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(of)))


def _has(text: Column, token: str, at: int | None = None) -> Column:
    """Whether text has a token, or begins with it (at 1); each follows one blank."""
    if at:
        return F.startswith(text, F.lit(f" {token}")) & ~text.rlike(rf"^ {token}\S")
    return F.contains(text, F.lit(f" {token}")) & text.rlike(rf" {token}(?!\S)")


def _last(text: Column, name: str) -> Column:
    """What follows `name:` in the last such token of text, else null."""
    return F.when(F.contains(text, F.lit(f" {name}:")), F.substring(F.regexp_extract(text, rf"(?s).* {name}:(\S*)", 1), 1, 100))


def _first_value(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf" ({'|'.join(SIXTY_FOURTHS)})(?!\S)", 1), F.lit(""))


def _dots(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.contains(text, F.lit(" dot")), F.regexp_count(text, F.lit(r" dot(?!\S)"))).otherwise(0)


def read_events(readings: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(events, measures) of token strings, tokens separated by blanks. Keys must be unique.

    events: keys, measure (from 0), n, onset and length (ticks), kind (note or rest), pos (diatonic steps from the middle line of
    the clef read before), acc, dur, dots, grace, bar_rest, bars (of a rest of many bars), voice, clef. measures: keys,
    measure, ticks (the latest time that any voice reaches) and events (how many).

    `measure` begins a measure; what comes before the first one belongs to none. A pitch or `rest` begins an event, a pitch
    after `chord` joins the note before it in the measure; note values, `dot` and AinB (A in the time of B) then tell its
    length, of chords the first head's. `grace` makes the next event take no time. `backup` and `forward` move the time by
    the length that follows; voice:N holds on, clef:X too. Unknown tokens are passed over, as are tuplets of nothing and
    lengths that follow no event. Empty measures at the end are left out; null and empty texts have none. Rows are events,
    never tokens: patterns part a measure's text into them, windows over them carry what holds on.
    """
    # A measure is a text in which every token follows one blank; line feeds part its events, a tab stands before a chord's other
    # heads and a carriage return before a move of the time. Rows are events with what follows them, and what opens a measure.
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    held = F.split(F.regexp_replace(plain, r" measure(?!\S)", "\n"), "\n")
    measures = readings.select(*keys, F.posexplode(held).alias("__m", "__t"), _count(held[0], " ").alias("__skipped")).where("__m > 0")
    parted = F.split(F.regexp_replace(F.regexp_replace("__t", r" (?=(?:backup|forward)(?!\S))", "\r "), rf" (?={HEAD})", "\n "), "\n")
    measures = measures.select(*keys, (F.col("__m") - 1).cast("long").alias("measure"), "__skipped", parted.alias("__by_head"))

    def mark(x: Column, k: Column) -> Column:
        before = F.get("__by_head", k - 1)
        joins = (k > 1) & ~_has(x, "rest", 1) & ~_has(before, "rest", 1) & _has(before, "chord")
        return F.when(joins, F.concat(F.lit("\t"), x)).when(k > 0, F.concat(F.lit("\n"), x)).otherwise(x)

    whole = F.when(F.size("__by_head") > 2, F.split(F.array_join(F.transform("__by_head", mark), ""), "\n")).otherwise(F.col("__by_head"))
    rows = measures.select(*keys, "measure", "__skipped", F.posexplode(whole).alias("__k", "__t"))

    t, made = F.col("__t"), F.col("__k") > 0
    rows = rows.withColumn("__own", F.substring_index("__t", "\r", 1)).withColumn("__open", F.substring_index("__own", "\t", 1))
    graced = _has(F.substring_index("__t", "\t", -1), "grace")
    rows = rows.select(
        *keys, "measure", "__k", "__skipped", "__t", "__own", "__open", (_count(t, " ") + F.when(made, 0).otherwise(1)).alias("__tokens"), _last(t, "clef").alias("__clef_after"), _last(t, "voice").alias("__voice_after"),
        F.when(made | graced, graced).alias("__grace_after"), F.when(made, _first_value("__open")).alias("dur"), F.when(made, _dots("__open")).alias("dots"),
        F.when(F.contains("__open", F.lit("in")), F.nullif(F.regexp_extract("__open", r"(?s).* ([1-9][0-9]{0,8}in[1-9][0-9]{0,8})(?!\S)", 1), F.lit(""))).alias("__tuplet"),
    )
    ratio = lambda n: F.regexp_extract("__tuplet", r"(\d+)in(\d+)", n).cast("long")
    length = F.when(F.col("__tuplet").isNull(), ticks(F.col("dur"), F.col("dots"))).otherwise(F.round(ticks(F.col("dur"), F.col("dots")) * ratio(2) / ratio(1)).cast("long"))
    sign = lambda x: F.when(F.startswith(x, F.lit(" backup")), -1).otherwise(1)
    moves = F.transform(F.slice(F.split("__t", "\r"), 2, 1 << 30), lambda x: sign(x) * ticks(_first_value(x), _dots(x)))
    reach = lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["top"], s["at"] + x).alias("top"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("top"))
    moved = F.when(F.contains("__t", F.lit("\r")), F.aggregate(moves, none, reach)).otherwise(none)
    rows = rows.withColumn("length", F.when(made, length)).withColumn("__moved", moved)

    # What was read before, in the whole text and in the measure: two windows of one order.
    before = Window.partitionBy(*keys).orderBy("measure", "__k").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "measure").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    in_force = lambda c, first: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(first))
    rows = rows.select(
        *keys, "measure", "__k", "__t", "__own", "dur", "dots", "length", "__moved", (F.col("__skipped") + F.coalesce(F.sum("__tokens").over(before), F.lit(0))).cast("int").alias("n"),
        in_force("__clef_after", "G2").alias("clef"), F.coalesce(_last(F.col("__open"), "voice"), in_force("__voice_after", "1")).alias("voice"), in_force("__grace_after", False).alias("grace"),
    )
    rows = rows.withColumn("__taken", F.when(made & ~F.col("grace"), F.col("length")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("onset", F.coalesce(F.sum(F.col("__taken") + F.col("__moved.at")).over(inside), F.lit(0)).cast("long"))

    rest = _has(t, "rest", 1)
    step = lambda pitch, clef: (diatonic(pitch) - diatonic(F.coalesce(lookup(MIDDLE, clef), F.lit("B4")))).cast("int")
    heads = F.split("__t", "\t")
    clef_at = lambda k: F.coalesce(_last(F.array_join(F.slice(heads, 1, k), ""), "clef"), F.col("clef"))
    pitch = lambda x: F.substring(x, 2, 2)
    chord = F.when(F.contains("__t", F.lit(" clef:")), F.transform(heads, lambda x, k: step(pitch(x), clef_at(k)))).otherwise(F.transform(heads, lambda x: step(pitch(x), F.col("clef"))))
    pos = F.when(rest, F.array().cast("array<int>")).when(F.contains("__t", F.lit("\t")), chord).otherwise(F.array(step(pitch(t), F.col("clef"))))
    altered = F.contains("__own", F.lit("sharp")) | F.contains("__own", F.lit("flat")) | F.contains("__own", F.lit("natural"))
    acc = F.when(altered, F.regexp_extract_all("__own", F.lit(rf" ({'|'.join(ACCIDENTALS)})(?!\S)"), 1)).otherwise(F.array().cast("array<string>"))
    many = F.when(F.contains("__own", F.lit(" multirest:")), F.nullif(F.regexp_extract("__own", r"(?s).* multirest:([0-9]{1,9})(?!\S)", 1), F.lit("")))
    events = rows.where(made).select(
        *keys, "measure", "n", "onset", "length", F.when(rest, "rest").otherwise("note").alias("kind"), pos.alias("pos"), acc.alias("acc"), F.coalesce(lookup(COMPARED, F.col("dur")), "dur").alias("dur"),
        F.col("dots").cast("int").alias("dots"), "grace", (rest & _has(F.col("__own"), "rest:measure")).alias("bar_rest"), F.when(rest, many.cast("int")).alias("bars"), "voice", "clef",
    )
    end = F.col("onset") + F.col("__taken") + F.col("__moved.top")
    measures = rows.groupBy(*keys, "measure").agg(F.greatest(F.max(end), F.lit(0)).alias("ticks"), F.count_if(made).alias("events"))
    kept = F.max(F.when(F.col("events") > 0, F.col("measure"))).over(Window.partitionBy(*keys))
    measures = measures.withColumn("kept", kept).where("measure <= kept").drop("kept")
    return events, measures


def voices_merged(events: DataFrame, bar: list[str], lists: tuple[str, ...] = ("pos", "acc")) -> DataFrame:
    """events in which notes that start together with equal lengths in different voices are one chord, and rests under another
    voice's note are gone.

    events: bar (keys), n (unique in a bar), onset, voice, kind, dur, dots, grace and the arrays `lists`, which are joined and
    sorted. The first such note in order of n takes those of other voices in; later ones of its own voice stay. Grace notes
    stay as they are. All is windows over one order: no bar is gathered.
    """
    note = (F.col("kind") == "note") & ~F.col("grace")
    # One order serves all: by onset, then by what makes notes alike.
    alike = Window.partitionBy(*bar, "onset", F.when(note, F.col("dur")), F.when(note, F.col("dots")), F.when(~note, F.col("n"))).orderBy("n")
    all_alike = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = events.withColumn("__n", F.first("n").over(all_alike)).withColumn("__v", F.first("voice").over(all_alike))
    gone = (F.col("n") != F.col("__n")) & ~F.col("__v").eqNullSafe(F.col("voice"))
    taken = F.collect_list(F.when(gone, F.struct(*lists))).over(all_alike)
    ranked = ranked.withColumn("__taken", taken).where(~gone)
    several = (F.col("n") == F.col("__n")) & (F.size("__taken") > 0)
    joined = lambda c: F.array_sort(F.concat(F.coalesce(c, F.array()), F.flatten(F.filter(F.transform("__taken", lambda x: x[c]), lambda x: x.isNotNull()))))
    merged = ranked.select(*[F.when(several, joined(c)).otherwise(F.col(c)).alias(c) if c in lists else c for c in events.columns])
    at = Window.partitionBy(*bar, "onset")
    sung = F.when(F.col("kind") == "note", F.col("voice"))
    merged = merged.withColumn("__lo", F.min(sung).over(at)).withColumn("__hi", F.max(sung).over(at))
    under = (F.col("kind") == "rest") & ((F.col("__lo") != F.col("voice")) | (F.col("__hi") != F.col("voice")))
    return merged.where(~F.coalesce(under, F.lit(False))).select(*events.columns)


def voice_lines(events: DataFrame, bar: list[str]) -> DataFrame:
    """(bar, n, line): 2 for an event that sounds against one of a lower voice, else 1; a grace note goes with the next event of
    its voice that isn't one, line 1 without any.

    events: bar (keys), n (unique in a bar), onset, length, voice (a number) and grace. Two events sound together if each
    begins before the other ends. Instead of pairing events, each one's start and end are swept in order: the lowest voice
    among what sounds is a running minimum of those that began before an event ends and end after it begins.
    """
    whole = events.where(~F.col("grace")).select(*bar, "n", F.col("voice").cast("int").alias("v"), F.col("onset").alias("a"), (F.col("onset") + F.col("length")).alias("z"))
    low = whole.select(*bar, F.col("v").alias("u"), F.col("a").alias("b"), F.col("z").alias("y"))
    # Of each lower voice the furthest end among those that begin before an event ends tells whether any sounds against it.
    voices = whole.groupBy(*bar).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    asked = whole.join(voices, bar).select(*bar, "n", "a", "z", F.explode_outer(F.filter("vs", lambda u: u < F.col("v"))).alias("u"))
    marks = asked.where("u is not null").select(*bar, "u", F.col("z").alias("at"), F.lit(0).alias("side"), "n", "a", F.lit(None).cast("long").alias("y"))
    marks = marks.unionByName(low.select(*bar, "u", F.col("b").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("a"), F.col("y").cast("long")))
    swept = Window.partitionBy(*bar, "u").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    under = marks.withColumn("far", F.max("y").over(swept)).where("side = 0 and far > a").select(*bar, "n").distinct().withColumn("__under", F.lit(True))
    line = F.when(~F.col("grace"), F.when(F.col("__under"), 2).otherwise(1))
    out = events.join(under, [*bar, "n"], "left").withColumn("line", line)
    after = Window.partitionBy(*bar, "voice").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    return out.select(*bar, "n", F.coalesce("line", F.first("line", ignorenulls=True).over(after), F.lit(1)).alias("line"))


#: Clef tokens by the clefs' names.
CLEF_TOKENS = {"treble": "clef:G2", "alto": "clef:C3", "tenor": "clef:C4", "bass": "clef:F4"}


def in_clef(events: Column, middle: Column) -> Column:
    """Read events (structs of kind, pos, dur, dots, grace, bar_rest and acc) as they are compared, at the pitches they have in a clef
    whose middle line is `middle` (a diatonic number): a rest that fills the bar, or a whole one, has the length `bar`."""

    def one(e: Column) -> Column:
        rest = e["kind"] == "rest"
        fills = rest & (F.coalesce(e["bar_rest"], F.lit(False)) | F.coalesce(e["dur"] == "whole", F.lit(False)))
        none = F.array().cast("array<string>")
        return F.struct(
            e["kind"].alias("kind"), F.when(rest, none).otherwise(F.array_sort(F.transform(e["pos"], lambda p: pitch_name(middle + p)))).alias("pitches"),
            F.when(fills, "bar").otherwise(e["dur"]).alias("dur"), F.when(fills, 0).otherwise(e["dots"]).alias("dots"), e["grace"].alias("grace"),
            F.when(rest, none).otherwise(F.array_sort(e["acc"])).alias("acc"),
        )

    return F.transform(events, one)


def opening_tokens(key: Column, clef: Column, starts: Column, time: Column) -> Column:
    """The tokens that a staff's reading begins with: its key (fifths); with a clef also the time, where the staff starts a movement,
    and the clef."""
    m = meter(time)
    timed = F.array(F.lit("time"), F.concat(F.lit("beats:"), F.get(m, F.lit(0)).cast("string")), F.concat(F.lit("beat-type:"), F.get(m, F.lit(1)).cast("string")))
    none = F.array().cast("array<string>")
    head = F.array(F.lit("measure"), F.concat(F.lit("key:fifths:"), key.cast("string")))
    return F.when(clef.isNull(), head).otherwise(F.concat(head, F.when(starts, timed).otherwise(none), F.array(lookup(CLEF_TOKENS, clef))))
