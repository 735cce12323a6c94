"""Older text forms of points and tracks, their readers, and answers that hold points.

Numbers are written in tenths, halves to even, which is how the forms were made; coordinates
are percent of the width and height unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import at_least

#: Patterns of points in text, in the order in which they are tried, and what 1.0 is in each
#: (fixed values).
READERS = (
    (r"Click\(([0-9]+\.[0-9]), ?([0-9]+\.[0-9])\)", 100.0),
    (r"[0-9]+ ([0-9]{3}) ([0-9]{3})", 1000.0),
    (r"[0-9]+ ([0-9]+\.[0-9]) ([0-9]+\.[0-9])", 100.0),
)
#: Patterns that are read together if none of the others is in the text (fixed values).
LAST_READERS = (
    (r"\(([0-9]+\.[0-9]),? ?([0-9]+\.[0-9])\)", 100.0),
    (r'x\d*="\s*([0-9]+(?:\.[0-9]+)?)"\s+y\d*="\s*([0-9]+(?:\.[0-9]+)?)"', 100.0),
    (r"(?:\d+|p)\s*=\s*([0-9]{3})\s*,\s*([0-9]{3})", 1000.0),
)
NONE = "There are none."


def tenths(v: Column) -> Column:
    """A number that isn't negative with one decimal."""
    n = F.rint(v * 10).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def ordered(points: Column) -> Column:
    """Points (structs of x, y) rounded to tenths, by x and then y."""
    rounded = F.transform(points, lambda p: F.struct((F.rint(p["x"] * 10) / 10).alias("x"), (F.rint(p["y"] * 10) / 10).alias("y")))
    return F.array_sort(rounded)


def _joined(points: Column, one) -> Column:
    return F.array_join(F.transform(points, one), " ")


def image_points(points: Column, label: Column, alt: Column, form: str = "default") -> Column:
    """Points of a picture as text: ``default`` (attributes), ``compact_v1`` (number, x, y in
    tenths) or ``compact_v2`` (in thousandths, three digits)."""
    p = ordered(points)
    if form == "default":
        one = F.concat(F.lit('<point x="'), tenths(F.get(p, F.lit(0))["x"]), F.lit('" y="'), tenths(F.get(p, F.lit(0))["y"]), F.lit('" alt="'), alt, F.lit('">'), label, F.lit("</point>"))
        n = lambda i: (i + 1).cast("string")
        each = _joined(p, lambda v, i: F.concat(F.lit("x"), n(i), F.lit('="'), tenths(v["x"]), F.lit('" y'), n(i), F.lit('="'), tenths(v["y"]), F.lit('"')))
        many = F.concat(F.lit("<points "), each, F.lit(' alt="'), alt, F.lit('">'), label, F.lit("</points>"))
        return F.when(F.size(p) == 1, one).otherwise(many)
    three = lambda v: at_least(F.rint(v * 10).cast("long").cast("string"), 3)
    write = {"compact_v1": tenths, "compact_v2": three}[form]
    body = _joined(p, lambda v, i: F.concat_ws(" ", (i + 1).cast("string"), write(v["x"]), write(v["y"])))
    clean = lambda c: F.replace(c, F.lit("\t"), F.lit(" "))
    other = F.when(alt.isNull() | (alt == clean(label)), F.lit("-")).otherwise(clean(alt))
    return F.concat(F.lit("<points "), clean(label), F.lit("\t"), other, F.lit("\t"), body, F.lit("/>"))


def image_answer(points: Column, label: Column, alt: Column, mode: str = "point", form: str = "default") -> Column:
    """The points alone, or a sentence that counts them."""
    text = image_points(points, label, alt, form)
    if mode in ("point_count", "point_then_count"):
        text = F.concat(F.lit("Counting the "), text, F.lit(" shows a total of "), F.size(points).cast("string"), F.lit("."))
    return F.when(F.size(points) == 0, NONE).otherwise(text)


def video_points(frames: Column, form: str = "default") -> Column:
    """Points of a video's frames (structs of time as text and points) as text; points are
    numbered through all frames."""
    sizes = F.transform(frames, lambda f: F.size(f["points"]))
    before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
    number = lambda i, k: (before(i) + k + 1).cast("string")

    def frame(f: Column, i: Column) -> Column:
        if form == "default":
            each = F.transform(f["points"], lambda p, k: F.concat(F.lit(" x"), number(i, k), F.lit("="), tenths(p["x"]), F.lit(" y"), number(i, k), F.lit("="), tenths(p["y"])))
            return F.concat(F.lit("<points t"), (i + 1).cast("string"), F.lit("="), f["time"], F.array_join(each, ""), F.lit("/>"))
        each = F.transform(f["points"], lambda p, k: F.concat_ws(" ", number(i, k), tenths(p["x"]), tenths(p["y"])))
        if form == "paragraph":
            return F.concat(f["time"], F.lit("\n"), F.array_join(F.transform(each, lambda s: F.concat(s, F.lit("\n"))), ""))
        if form == "compact_v1":
            return F.concat(F.lit("<points "), f["time"], F.lit("\t"), F.array_join(each, " "), F.lit("/>"))
        raise ValueError(f"no form {form}")

    return F.rtrim(F.array_join(F.transform(frames, frame), " "), F.lit(" \n"))


def video_answer(frames: Column, label: Column, mode: str = "point", form: str = "default") -> Column:
    total = F.aggregate(F.transform(frames, lambda f: F.size(f["points"])), F.lit(0), lambda a, x: a + x).cast("string")
    text, named = video_points(frames, form), F.concat(F.lit('"'), label, F.lit('"'))
    if mode == "point_count":
        text = F.concat(F.lit("The "), named, F.lit(" are located at: "), text, F.lit(".\nCounting shows the total number is: "), total, F.lit("."))
    elif mode == "count_point":
        text = F.concat(F.lit("The total number of "), named, F.lit(" is: "), total, F.lit(".\nThey are located at: "), text, F.lit("."))
    elif mode == "count":
        text = F.concat(F.lit("The total number of "), named, F.lit(" is: "), total, F.lit("."))
    elif mode not in ("point", "pointing"):
        raise ValueError(f"no mode {mode}")
    return F.when(F.size(frames) == 0, NONE).otherwise(text)


def frame_tracks(frames: Column, occlusion: bool = False) -> Column:
    """``time t`` and ``{id: [x, y], ...}`` for each frame (structs of time as text and points of
    id, x, y, occluded) that has points; with ``occlusion`` hidden points stay and say so."""

    def one(f: Column) -> Column:
        shown = f["points"] if occlusion else F.filter(f["points"], lambda p: ~p["occluded"])
        mark = lambda p: F.when(p["occluded"], ", yes]").otherwise("]")
        each = F.transform(F.array_sort(shown), lambda p: F.concat(p["id"].cast("string"), F.lit(": ["), tenths(p["x"]), F.lit(", "), tenths(p["y"]), mark(p)))
        return F.when(F.size(shown) > 0, F.concat(F.lit("time "), f["time"], F.lit("\n{"), F.array_join(each, ", "), F.lit("}")))

    return F.array_join(F.filter(F.transform(frames, one), lambda s: s.isNotNull()), "\n")


def start_end_tracks(tracks: Column) -> Column:
    """``id: ([x, y, t], [x, y, t])`` for each track (struct of id and points in order of time, of
    t as text, x, y) of two points or more."""
    at = lambda p: F.concat(F.lit("["), tenths(p["x"]), F.lit(", "), tenths(p["y"]), F.lit(", "), p["t"], F.lit("]"))
    one = lambda k: F.concat(k["id"].cast("string"), F.lit(": ("), at(F.element_at(k["points"], 1)), F.lit(", "), at(F.element_at(k["points"], -1)), F.lit(")"))
    return F.array_join(F.transform(F.filter(tracks, lambda k: F.size(k["points"]) > 1), one), "\n")


def single_track(points: Column) -> Column:
    """``[x, y, t], ...`` of a track's visible points but the first."""
    rest = F.filter(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p: ~p["occluded"])
    return F.array_join(F.transform(rest, lambda p: F.concat(F.lit("["), tenths(p["x"]), F.lit(", "), tenths(p["y"]), F.lit(", "), p["t"], F.lit("]"))), ", ")


def _read(text: Column, pattern: str, whole: float, width: Column, height: Column) -> Column:
    """Points of one pattern in pixels; those outside the picture go."""
    xs, ys = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    p = F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    inside = F.filter(p, lambda v: F.greatest(v["x"], v["y"]) <= whole)
    return F.transform(inside, lambda v: F.struct((v["x"] / whole * width).alias("x"), (v["y"] / whole * height).alias("y")))


def read_points(text: Column, width: Column, height: Column) -> Column:
    """Points of any older form: the first reader that finds some decides, else all the last ones."""
    found = F.concat(*[_read(text, p, w, width, height) for p, w in LAST_READERS])
    for p, w in reversed(READERS):
        own = _read(text, p, w, width, height)
        found = F.when(F.size(own) > 0, own).otherwise(found)
    return found


def read_timed_points(text: Column, width: Column, height: Column) -> Column:
    """Points (t, x, y) of ``<points t n x y n x y .../>`` blocks; null where a block isn't made of
    triples."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit("<points\\s+([^/>]*?)\\s*/>"), F.lit(1)), lambda b: F.split(F.trim(b), "\\s+"))
    blocks = F.filter(blocks, lambda b: F.get(b, F.lit(0)) != "")
    broken = F.exists(blocks, lambda b: ((F.size(b) - 1) % 3 != 0) | F.exists(b, lambda x: x.try_cast("double").isNull()))

    def points(b: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: (i % 3 == 1) & (i + 2 < F.size(b)))
        at = lambda i, k: F.get(b, i + k).try_cast("double")
        return F.transform(starts, lambda i: F.struct(F.get(b, F.lit(0)).try_cast("double").alias("t"), at(i, 1).alias("x"), at(i, 2).alias("y")))

    rows = F.filter(F.flatten(F.transform(blocks, points)), lambda p: F.greatest(p["x"], p["y"]) <= 100)
    return F.when(~broken, F.transform(rows, lambda p: F.struct(p["t"].alias("t"), (p["x"] / 100 * width).alias("x"), (p["y"] / 100 * height).alias("y"))))


def first_found(*readings: Column) -> Column:
    """The first reading that isn't null or empty."""
    out = readings[-1]
    for r in reversed(readings[:-1]):
        out = F.when(F.size(F.coalesce(r, F.array().cast("array<struct<x:double,y:double>>"))) > 0, r).otherwise(out)
    return out


def inline_points(text: Column, annotations: Column, mark: str = "<|POINT|>") -> Column:
    """``text`` with each mark, from left to right, replaced by the text of an annotation. A mark
    without an annotation stays; an annotation without a mark is left out."""
    parts = F.split(text, "\\Q" + mark + "\\E", -1)
    fill = lambda i: F.when(i == 0, "").otherwise(F.coalesce(F.get(annotations, i - 1), F.lit(mark)))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(fill(i), p)), "")


def fps_of(text: Column, default: int = 2) -> Column:
    """Frames in the first second by the times before picture marks; at least 1."""
    times = F.transform(F.regexp_extract_all(text, F.lit("\\b(\\d+\\.\\d+)\\s+<im_start>"), F.lit(1)), lambda x: x.cast("double"))
    n = F.size(F.array_distinct(F.filter(times, lambda x: x < 1.0)))
    return F.when(F.size(times) == 0, default).otherwise(F.greatest(F.lit(1), n))


def chat_messages(messages: Column, form: str = "qwen3", space_first: bool = False) -> Column:
    """Messages, users' and assistants' in turn, with the marks of a chat form (``qwen3``,
    ``role`` or ``none``)."""

    def one(m: Column, i: Column) -> Column:
        user = i % 2 == 0
        if form == "qwen3":
            asked = F.concat(F.when(i != 0, "<|im_end|>\n").otherwise(""), F.lit("<|im_start|>user\n"), m, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
            return F.when(user, asked).otherwise(m)
        if form not in ("role", "none"):
            raise ValueError(f"no chat form {form}")
        said = F.when(user, F.concat(F.lit("User: "), m, F.lit(" Assistant:"))).otherwise(m) if form == "role" else m
        return F.concat(F.lit(" "), said) if space_first else F.when(i != 0, F.concat(F.lit(" "), said)).otherwise(said)

    return F.transform(messages, one)
