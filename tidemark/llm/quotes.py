"""Conversations rebuilt by quotation linking.

A line's quote level is its leading ``>`` marks. Quoted lines of one level in a row are a passage. A passage is
normalised (case, white space, marks) and hashed, however short. What a message says itself can be quoted whole, or as
any run of lines or of sentences of one of its paragraphs; such runs are hashed by prefix sums, and only those with as
many words as some passage has, so hashes grow with the text and not with the square of a paragraph. A passage finds
the message it quotes by an equi-join on the hash.

Messages are ordered by turn. A message replies to the latest earlier message of its own conversation that it quotes at
the shallowest level, else to the first one elsewhere if that is earlier, else to the message before it in its
conversation. Every reply thus follows what it replies to, and replies form trees. A tree is a thread, named by the
conversation it began in; ``position`` is a message's place in its thread, by the same order, so it comes after all
that it replies to. Quoted lines, attribution lines before them, and nothing else leave the text.
``threads`` gives the threads themselves, in parts of PART messages.

A place is counted per range of turns first and within the range after, so a thread of any length is never gathered in
one task. Roots are found by pointer jumping over the messages that quote something, as the others belong to the
thread of the last one before them.

Defined results: a null text has no own text and no quotes; a passage whose original isn't in the table, or stands
nowhere before it, links to nothing; messages that share a thread and turn share a place, those of one conversation and turn, repeated ones too, links as
well; all keep their rows, and later places count them all; a null turn sorts first, a null conversation is one like
any other; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_arrow

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
#: Turns counted together; messages of a part of a thread.
RANGE = 1024
PART = 256
#: What ends a sentence, with closing marks; nothing of it is left when normalised.
SENTENCE = re.compile(r"[.!?…]+[\"')\]”’»]*\s+|[。！？]+[”’』」）]*\s*")
WORD = re.compile(r"\w+")
#: Modulus and base of the hashes of word runs.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: What a null turn sorts as.
FIRST = -(1 << 62)


def _words(text: str) -> list[int]:
    """A number for each word of a text, which are what is left of it when normalised."""
    return [xxhash.xxh64_intdigest(w.encode(), 7) % PRIME for w in WORD.findall(text.lower())]


def _sums(words: list[int]) -> tuple[list[int], list[int]]:
    """Prefix hashes of a word sequence and the powers of the base."""
    sums, powers = [0], [1]
    for w in words:
        sums.append((sums[-1] * BASE + w + 1) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    return sums, powers


def _passage(lines: list[str]) -> tuple[int, int] | None:
    """Hash and number of words of a passage; None without words."""
    words = _words(" ".join(lines))
    return (_sums(words)[0][-1], len(words)) if words else None


def _runs(parts: list[str], wanted: list[int], found: set[tuple[int, int]]) -> None:
    """Adds (hash, words) of every run of neighbouring parts that has a wanted number of words."""
    edges, words = [0], []
    for part in parts:
        words += _words(part)
        if len(words) > edges[-1]:
            edges.append(len(words))
    if len(edges) < 2:
        return
    sums, powers = _sums(words)
    at, total, some = set(edges), edges[-1], set(wanted)
    for i, a in enumerate(edges[:-1]):
        later = edges[i + 1 :]
        ends = [z for z in later if z - a in some] if len(later) < len(wanted) else [a + w for w in wanted if a + w <= total and a + w in at]
        for z in ends:
            found.add(((sums[z] - sums[a] * powers[z - a]) % PRIME, z - a))


def split(text: str | None) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without quotes, and its quoted passages as (level, hash, words)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        mark = MARK.match(line)
        if not mark:
            own.append(line)
            passages.append((0, []))
            continue
        level = mark[1].count(">")
        body = line[mark.end() :]
        if own and passages[-1:] == [(0, [])] and ATTRIBUTION.match(own[-1]):
            own.pop()
        if passages and passages[-1][0] == level and body.strip():
            passages[-1][1].append(body)
        else:
            passages.append((level, [body] if body.strip() else []))
    quoted = [(level, _passage(lines)) for level, lines in passages if level and lines]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(level, *p) for level, p in quoted if p]


def said(clean: str, wanted: list[int]) -> list[tuple[int, int]]:
    """(hash, words) of the whole of a text without quotes, and of the runs of lines and of sentences of each paragraph,
    as far as their number of words is a wanted one."""
    found: set[tuple[int, int]] = set()
    _runs([clean], wanted, found)
    for paragraph in re.split(r"\n\s*\n", clean):
        _runs(paragraph.split("\n"), wanted, found)
        _runs(SENTENCE.split(paragraph), wanted, found)
    return sorted(found)


def _messages(messages: DataFrame, *more: str) -> DataFrame:
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.col(c).cast("string").alias(c) for c in more])


def quoted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, h and words of every quoted passage."""

    def run(batches):
        for batch in batches:
            rows = [(i, *q) for i, t in enumerate(batch.column(2)) for q in split(t.as_py())[1]]
            i, *columns = zip(*rows, strict=True) if rows else [[]] * 4
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in columns)], ["conv_id", "turn", "level", "h", "words"])

    marked = _messages(messages, "text").where("contains(text, '>')")
    return map_arrow(marked, run, "conv_id long, turn long, level long, h long, words long").distinct()


def originals(messages: DataFrame, wanted: list[int]) -> DataFrame:
    """conv_id, turn, h and words of what messages say themselves, for the wanted numbers of words."""

    def run(batches):
        for batch in batches:
            rows = [(i, *h) for i, t in enumerate(batch.column(2)) for h in said(split(t.as_py())[0], wanted)]
            i, *columns = zip(*rows, strict=True) if rows else [[]] * 3
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in columns)], ["conv_id", "turn", "h", "words"])

    return map_arrow(_messages(messages, "text"), run, "conv_id long, turn long, h long, words long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _at(turn: str = "turn") -> Column:
    return F.coalesce(turn, F.lit(FIRST))


def _carried(rows: DataFrame, keys: tuple[str, ...], marks: dict[str, tuple[Column, int]]) -> DataFrame:
    """rows with, for each mark, the latest one before (-1) or up to (0) the row's ``at`` among the rows of its keys.

    A mark is null or a struct that begins with ``at``. It is looked for among the rows of the same range first, then
    among the ranges before, so no task holds all rows of a key.
    """
    rows = rows.withColumn("_range", F.floor(F.col("at") / RANGE)).withColumns({f"_m_{n}": m for n, (m, _) in marks.items()})
    inside = Window.partitionBy(*keys, "_range").orderBy("at")
    found = rows.withColumns({f"_i_{n}": F.max(f"_m_{n}").over(inside.rangeBetween(Window.unboundedPreceding, last)) for n, (_, last) in marks.items()})
    tops = rows.groupBy(*keys, "_range").agg(*[F.max(f"_m_{n}").alias(f"_t_{n}") for n in marks])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    steps = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in marks])
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & _same(k, f"_k_{k}")
    kept = [c for c in rows.columns if c != "_range" and not c.startswith("_m_")]
    return found.join(steps, on).select(*kept, *[F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in marks])


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level and the quoted message (to_conv, to_turn) for every passage with an original before it.

    Only hashes that are quoted anywhere are looked for among what is said: the numbers of words that passages have, a
    few whole numbers, go to the workers, and the quotes' distinct hashes reduce what they find. Originals are then
    reduced to the latest per hash, conversation and range of turns, plus the first two of different conversations per
    hash for quotes across conversations (one isn't the quoter's own), so a passage that everyone says doesn't multiply.
    """
    asking = cut(quoted(messages))
    wanted = [r["words"] for r in asking.select("words").distinct().orderBy("words").collect()]  # as many as passages have lengths
    if not wanted:
        return asking.select("conv_id", "turn", "level", F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
    asked = asking.select("h", "words").distinct()
    spoken = cut(originals(messages, wanted).join(asked, ["h", "words"], "left_semi").select("h", "words", "conv_id", "turn").distinct())
    events = spoken.select("h", "words", "conv_id", "turn", F.lit(0).cast("long").alias("level"), F.lit(True).alias("origin")).union(asking.select("h", "words", "conv_id", "turn", "level", F.lit(False).alias("origin")))
    events = events.withColumn("at", _at())
    found = _carried(events, ("h", "words", "conv_id"), {"own": (F.when(F.col("origin"), F.struct("at", "turn")), -1)}).where("NOT origin")
    starts = spoken.groupBy("h", "words", F.col("conv_id").alias("to_conv")).agg(F.min(F.struct(_at().alias("to_at"), F.col("turn").alias("to_turn"))).alias("s"))
    leading = starts.select("h", "words", "to_conv", "s.*").withColumn("_n", F.row_number().over(Window.partitionBy("h", "words").orderBy("to_at", "to_conv"))).where("_n <= 2")
    first = leading.groupBy("h", "words").agg(*(F.min(F.when(F.col("_n") == n, F.struct("to_at", "to_turn", "to_conv"))).alias(name) for n, name in ((1, "first"), (2, "second"))))
    found = found.join(first, ["h", "words"], "left")
    elsewhere = lambda c: F.col(c).isNotNull() & ~_same(f"{c}.to_conv", "conv_id")
    far = F.when(elsewhere("first"), F.col("first")).when(elsewhere("second"), F.col("second"))
    found = found.withColumn("far", far).withColumn("far", F.when(F.col("far.to_at") < F.col("at"), F.col("far")))
    local = F.col("own").isNotNull()
    return found.where(local | F.col("far").isNotNull()).select(
        "conv_id", "turn", "level", F.when(local, F.col("conv_id")).otherwise(F.col("far.to_conv")).alias("to_conv"), F.when(local, F.col("own.turn")).otherwise(F.col("far.to_turn")).alias("to_turn"))


def roots(linked: DataFrame) -> DataFrame:
    """conv_id, turn and thread, the conversation in which its thread began, of messages with links (conv_id, turn, to_conv,
    to_turn), one each, by pointer jumping.

    A target belongs to the thread of the last linking message at or before it in its conversation, or, without one, to
    the thread that the conversation began. Each round doubles the reach.
    """
    marks = linked.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("mark"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"))
    ends = linked.select(F.col("to_conv").alias("c"), F.col("to_turn").alias("t"), F.lit(False).alias("mark"), "conv_id", "turn")
    hung = _carried(marks.union(ends).withColumn("at", _at("t")), ("c",), {"on": (F.when(F.col("mark"), F.struct("at", "t")), 0)}).where("NOT mark")
    state = cut(hung.select("conv_id", "turn", F.col("c").alias("thread"), F.col("on").isNotNull().alias("more"), F.col("on.t").alias("next")))
    while state.where("more").limit(1).count():
        above = state.select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("thread").alias("a_thread"), F.col("more").alias("a_more"), F.col("next").alias("a_next"))
        met = state.where("more").join(above, _same("thread", "a_conv") & _same("next", "a_turn"))
        jumped = met.select("conv_id", "turn", F.col("a_thread").alias("thread"), F.col("a_more").alias("more"), F.col("a_next").alias("next"))
        state = cut(state.where("NOT more").union(jumped))
    return state.select("conv_id", "turn", "thread")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), thread, position, reply_to_conv, reply_to_turn, n_links for every
    message. ``thread`` is the conversation in which its thread began."""
    nearest = F.struct("level", (~_same("to_conv", "conv_id")).alias("far"), (-_at("to_turn")).alias("late"), "to_conv", "to_turn")
    best = links(messages).groupBy("conv_id", "turn").agg(F.min(nearest).alias("b"), F.count("*").alias("n_links"))
    best = cut(best.select("conv_id", "turn", "b.to_conv", "b.to_turn", "n_links"))
    rows = _messages(messages, "role", "text")
    # one row for each conversation and turn
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("c"))
    left = roots(best).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.struct("thread").alias("moved"))
    turns = turns.join(left, _same("conv_id", "_c") & _same("turn", "_t"), "left").drop("_c", "_t").withColumn("at", _at())
    carried = {"previous": (F.struct("at", "turn"), -1), "since": (F.when(F.col("moved").isNotNull(), F.struct("at", "moved")), 0)}
    turns = _carried(turns, ("conv_id",), carried)
    turns = cut(turns.select("conv_id", "turn", "at", "c", F.when(F.col("previous").isNotNull(), F.struct("previous.turn")).alias("previous"), F.when(F.col("since").isNotNull(), F.col("since.moved.thread")).otherwise(F.col("conv_id")).alias("thread")))
    # places: what stands at earlier turns of the thread, counted in ranges of turns
    sums = turns.groupBy("thread", "at").agg(F.sum("c").alias("c")).withColumn("_range", F.floor(F.col("at") / RANGE))
    inside = Window.partitionBy("thread", "_range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("thread").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.groupBy("thread", "_range").agg(F.sum("c").alias("n")).select(F.col("thread").alias("_th"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    places = sums.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(bases, _same("thread", "_th") & (F.col("_range") == F.col("_r")))
    places = places.select(F.col("thread").alias("_th"), F.col("at").alias("_a"), (F.col("base") + F.col("inside")).alias("position"))
    counted = turns.join(places, _same("thread", "_th") & (F.col("at") == F.col("_a"))).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "thread", "position", "previous")
    counted = counted.join(best.withColumnsRenamed({"conv_id": "_bc", "turn": "_bt"}), _same("_c", "_bc") & _same("_t", "_bt"), "left").drop("_bc", "_bt")

    def cleaned(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([split(t.as_py())[0] for t in batch.column(3)], pa.string())], ["conv_id", "turn", "role", "text"])

    clean = map_arrow(rows, cleaned, "conv_id long, turn long, role string, text string")
    linked = F.col("n_links").isNotNull()
    return clean.join(counted, _same("conv_id", "_c") & _same("turn", "_t")).select(
        "conv_id", "turn", "role", "text", "thread", "position",
        F.when(linked, F.col("to_conv")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("reply_to_conv"),
        F.when(linked, F.col("to_turn")).otherwise(F.col("previous.turn")).alias("reply_to_turn"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def threads(messages: DataFrame, part: int = PART) -> DataFrame:
    """thread, part and messages: the threads in reply order without quotes, ``part`` places to a row, so that a long
    thread takes many rows. Messages that share a place stand together."""
    made = conversations(messages).withColumn("part", F.floor(F.col("position") / part))
    line = F.struct("position", "conv_id", "turn", "role", "text", "reply_to_conv", "reply_to_turn")
    return made.groupBy("thread", "part").agg(F.sort_array(F.collect_list(line)).alias("messages"))
