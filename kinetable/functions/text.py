"""Text, time and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_text(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation as one text with marks around every turn, in order."""
    one = F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.col(text), F.lit("<|im_end|>"))
    turns = df.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), one.alias("s")))).alias("x"))
    return turns.select(conversation, F.array_join(F.transform("x", lambda v: v["s"]), "\n").alias("chat"))


def parse_time(text: Column) -> Column:
    """Seconds of ``HH:MM:SS.f``, ``MM:SS.f`` or a number; null for anything else."""
    parts = F.split(F.trim(text), ":")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(n == 1, at(0)).when(n == 2, at(0) * 60 + at(1)).when(n == 3, at(0) * 3600 + at(1) * 60 + at(2))


def at_least(digits: Column, n: int) -> Column:
    """Filled with zeros from the left to n digits; longer ones stay (lpad would cut them)."""
    return F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)


def format_time(seconds: Column) -> Column:
    """``HH:MM:SS.ss`` from hundredths, halves to even."""
    h = F.rint(seconds * 100).cast("long")
    two = lambda v: at_least(v.cast("string"), 2)
    return F.concat(two(F.floor(h / 360000)), F.lit(":"), two(F.floor(h / 6000) % 60), F.lit(":"), two(F.floor(h / 100) % 60), F.lit("."), two(h % 100))


def object_list(text: Column, mark: str = "\\|") -> Column:
    """Trimmed, non-empty parts of a list in text."""
    return F.filter(F.transform(F.split(text, mark), lambda s: F.trim(s)), lambda s: s != "")


def caption(text: Column, stem: Column) -> Column:
    """The caption, or the inner words of a file stem where there is none."""
    words = F.split(stem, "_")
    inner = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), inner)


def clean_caption(text: Column) -> Column:
    """Without trailing punctuation and outer space."""
    return F.trim(F.regexp_replace(F.trim(text), "[.,;:]+\\z", ""))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Quantities that are measured rather than counted, as patterns (fixed values).
MEASURED = (
    "years", "months", "weeks", "days", "hours", "minutes", "[a-z]*seconds",
    "(tera|giga|mega|deci|kilo||micro|centi|milli|nano|pico|deca)meters", "meters", "metres", "acres", "leagues", "fathoms", "nautical miles", "hectares",
    "(square |SQ )?inches", "(square |SQ )feet", "(square |SQ )?ft", "(square |SQ )?miles", "(square | SQ)?yards", "passing yards",
    "dollars", "cents", "pounds", "euros", "seed", "mph", "kph", "more", "fewer", "less", "likes",
    "cubic", "gallons", "quarts", "pints", "fluid ounces", "[a-z]*liters", "weight", "[a-z]*grams", "pounds", "tons", "ounces", "ways", "different ways",
    "degrees", "calories", "hertz", "horsepower", "[a-z]*bytes", "psi", "atmospheres", "[a-z]*watts",
)
#: What else isn't counted after "the number of" and the like, and the words that ask for a number (fixed values).
NOT_AFTER = ("money", "the")
ASKED = (
    r"how ?many (?!{measured})",
    r"(?<!do not )(count|tally) (all|every|each|the) ",
    r"(there are|a total of) _{{3,4}}",
    r"(what|(what's|what (is|was|were)|states?|indicates?) the( exact| precise)?) (total count|count|total|total number|number|num|total amount|amount) of (?!{after})",
)


def counting_question(text: Column) -> Column:
    """Whether a question asks for a number of things that can be pointed at."""
    known = {"measured": "|".join(MEASURED), "after": "|".join((*MEASURED, *NOT_AFTER))}
    asked = "|".join(p.format(**known) for p in ASKED)
    return text.rlike(f"(?is)\\A(?!approximately).*(\\b|\\n)({asked})\\b")


def loss_mask(roles: Column) -> Column:
    """1 for turns of the assistant."""
    return F.transform(roles, lambda r: (r == "assistant").cast("int"))


def shift_targets(ids: Column, end_id: int) -> Column:
    """What each token should predict: the next one, at last the end mark."""
    return F.concat(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(end_id)))


def numbered_turns(texts: Column, mark: str = "Q") -> Column:
    return F.transform(texts, lambda t, i: F.concat(F.lit(mark), (i + 1).cast("string"), F.lit(": "), t))


def plain_question(points: Column, times: Column, history: Column, action: Column, tracks: Column) -> Column:
    """The first form of the question, to the byte."""
    part = lambda s: F.lit(s)
    n = lambda c: c.cast("string")
    return F.concat(
        part("Predict the future 3D trajectories of "), n(points), part(" points over "), n(times), part(" timestamps, given action: "), action, part(", and "), n(history), part(" history frames:\n"), tracks
    )


def field_question(points: Column, times: Column, action: Column, fields: dict[str, Column], endpoint: Column) -> Column:
    """The question with its fields that are there, the last of several after an "and"."""
    named = [F.concat(F.lit(f'{k}: "'), v, F.lit('"')) for k, v in {"given action": action, **fields}.items()]
    there = F.filter(F.array(*named), lambda s: s.isNotNull())
    listed = F.transform(there, lambda s, i: F.when((i > 0) & (i == F.size(there) - 1), F.concat(F.lit("and "), s)).otherwise(s))
    head = F.concat(F.lit("Predict the future 3D point coordinates of "), points.cast("string"), F.lit(" points over "), times.cast("string"), F.lit(" timestamps, "))
    return F.concat(head, F.array_join(listed, ", "), F.lit("."), F.when(endpoint, " predict the endpoint 3d coordinate first.").otherwise(""))


def elapsed(seconds: Column) -> Column:
    """Whole seconds as ``1 day, 2:03:04``."""
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    days = F.floor(seconds / 86400)
    named = F.when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).when(days == 1, "1 day, ").otherwise("")
    return F.concat(named, F.floor(seconds % 86400 / 3600).cast("string"), F.lit(":"), two(F.floor(seconds % 3600 / 60)), F.lit(":"), two((seconds % 60).cast("long")))


def flattened(df: DataFrame, mark: str = ".") -> DataFrame:
    """Every field of nested columns as a column named by its path."""
    from pyspark.sql.types import StructType

    def paths(schema: StructType, path: tuple[str, ...] = ()):
        for f in schema:
            if isinstance(f.dataType, StructType):
                yield from paths(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    quoted = lambda p: ".".join(f"`{n}`" for n in p)
    return df.select(*[F.col(quoted(p)).alias(mark.join(p)) for p in paths(df.schema)])


def nested(df: DataFrame, mark: str = ".") -> DataFrame:
    """Columns named by paths as nested columns."""
    tree: dict = {}
    for c in df.columns:
        *path, last = c.split(mark)
        at = tree
        for p in path:
            at = at.setdefault(p, {})
        at[last] = c

    def built(node):
        return F.col(f"`{node}`") if isinstance(node, str) else F.struct(*[built(v).alias(k) for k, v in node.items()])

    return df.select(*[built(v).alias(k) for k, v in tree.items()])


def release_name(name: Column) -> Column:
    """House, batch and kind of ``house_<n>__trajectories_batch_<k>.<kind>``; null for other names."""
    part = lambda i: F.regexp_extract(name, "^(house_\\d+)__trajectories_batch_(\\d+)\\.(\\w+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("house"), part(2).try_cast("int").alias("batch"), part(3).alias("kind")))


def subtitle_block(lines: Column, most: int) -> Column:
    """Lines (structs in order, with ``line``) under a heading, the last ones left out that would
    make the block longer than ``most`` characters."""
    text = F.transform(lines, lambda v: v["line"])
    ends = F.transform(text, lambda s, i: F.aggregate(F.slice(text, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x) + 1))
    kept = F.filter(text, lambda s, i: F.get(ends, i) <= most)
    return F.when(F.size(kept) > 0, F.concat(F.lit("Subtitles:\n"), F.array_join(kept, "\n"))).otherwise("")


def checkpoint_name(path: Column) -> tuple[Column, Column]:
    """Step and whether it is in one piece, from the name of a checkpoint's folder; other names
    have no step."""
    pattern = "/step([0-9]+)(-unsharded)?"
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found.cast("long")), F.regexp_extract(path, pattern, 2) != ""
