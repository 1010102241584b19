"""Chat formatting by DataFrame expressions: turns to one training string, and back.

A conversation's turn structs are collected and sorted, the array is cut where the role changes, each cut is joined to
one block of several parts, and the blocks are concatenated:

    <|turn|>role\\n text (<|part|> text)* <|end|>\\n

Inside roles and texts & becomes &amp;, < becomes &lt; and [ becomes &#91;, so no control string of this or of another
template (such as </s> or [INST]) is left, and reading back is exact; line feeds inside roles become &#10;. `loss` holds (start, length) in characters of each
assistant text in the formatted string.

Null texts and roles count as empty; turns of equal number are in order of role and text, repeated rows stay, a null
turn comes first, rows of a null conversation form one; an empty table gives no rows; other columns are left out; ids and
turns may be of any type that can be grouped and ordered. Work is linear in a conversation's turns and characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>\n"
CHUNK = 256
#: Characters that a long text is cut into before pieces are taken from it.
PAGE = 4096


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def escaped_role(x: Column) -> Column:
    """A role ends with its line, so its own line feeds are escaped too."""
    return F.replace(escaped(x), F.lit("\n"), F.lit("&#10;"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often, and inside whatever lambda, `then` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def format_chats(turns: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """id, formatted, loss: array of (start, length)."""
    rows = turns.select(F.col(id).alias("_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    chats = rows.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chats = chats.select("_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), escaped(x["text"]).alias("body"))).alias("t"))
    changed = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    cut = lambda t, firsts: F.transform(firsts, lambda i, k: F.slice(t, i + 1, F.coalesce(F.get(firsts, k + 1), F.size(t)) - i))
    chats = chats.withColumn("blocks", let(F.col("t"), lambda t: let(changed(t), lambda firsts: cut(t, firsts))))
    head = lambda x: F.concat(F.lit(TURN), escaped_role(x["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b[0]), F.array_join(F.transform(b, lambda x: x["body"]), PART), F.lit(END))), "")
    # Each turn: what stands before its text (its block's head or the mark between parts), the text, and what follows at a block's end.
    place = lambda b, x, i: F.struct(
        F.when(i == 0, F.char_length(head(x))).otherwise(len(PART)).cast("long").alias("before"),
        F.char_length(x["body"]).cast("long").alias("length"),
        F.when(i == F.size(b) - 1, len(END)).otherwise(0).cast("long").alias("after"),
        (x["role"] == learn).alias("learn"),
    )
    chats = chats.select("_id", formatted.alias("formatted"), F.flatten(F.transform("blocks", lambda b: F.transform(b, lambda x, i: place(b, x, i)))).alias("places"))
    starts = running(F.transform("places", lambda p: p["before"] + p["length"] + p["after"]))
    spans = F.transform(F.arrays_zip(starts.alias("start"), F.col("places").alias("place")), lambda z: F.struct((z["start"] + z["place"]["before"]).alias("start"), z["place"]["length"].alias("length"), z["place"]["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return chats.select(F.col("_id").alias(id), "formatted", loss.alias("loss"))


def running(numbers: Column) -> Column:
    """The sum before each of an array's numbers (one at least). Sums grow inside chunks, then over chunks, so no long array is copied for each number."""
    sums = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    chunked = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: sums(F.slice(a, c * CHUNK + 1, CHUNK)))
    whole = lambda c: let(sums(F.transform(c, lambda x: F.element_at(x, -1))), lambda base: F.flatten(F.transform(c, lambda own, k: F.transform(F.slice(own, 1, F.size(own) - 1), lambda x: x + F.get(base, k)))))
    return let(let(numbers, chunked), whole)


def substrings(text: Column, spans: Column) -> Column:
    """The pieces (start, length in characters) of a text, taken from pages of it, so that a long text isn't walked from its start for each."""
    def piece(pages: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PAGE).cast("int")
        last = F.floor((s["start"] + s["length"]) / PAGE).cast("int")
        return F.substring(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), (s["start"] - first * PAGE + 1).cast("int"), s["length"].cast("int"))

    return let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PAGE}}})"), F.lit(1)), lambda pages: F.transform(spans, lambda s: piece(pages, s)))


def read_chats(chats: DataFrame, *, id: str = "conv_id") -> DataFrame:
    """id, turns: array of (role, text), learned: the text under the loss mask; all from formatted and loss alone."""
    blocks = let(F.split("formatted", r"<\|turn\|>"), lambda b: F.slice(b, 2, F.size(b)))
    parts = lambda b: let(F.char_length(F.substring_index(b, "\n", 1)), lambda n: F.struct(
        unescaped(F.replace(F.substring(b, F.lit(1), n), F.lit("&#10;"), F.lit("\n"))).alias("role"),
        F.split(F.substring(b, n + 2, F.char_length(b) - n - 1 - len(END)), r"<\|part\|>").alias("texts"),
    ))
    turns = F.flatten(F.transform(F.transform(blocks, parts), lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescaped(x).alias("text")))))
    learned = F.array_join(F.transform(substrings(F.col("formatted"), F.col("loss")), unescaped), "")
    return chats.select(id, turns.alias("turns"), learned.alias("learned"), "formatted")
