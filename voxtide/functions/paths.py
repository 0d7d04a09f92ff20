"""Path expressions; both separators are understood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[/\\]"


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; unchanged when it does not lie there."""
    prefix = root.rstrip("/\\") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def relative_output_path(relative: Column, extension: str = ".vtt") -> Column:
    """The same place in the output tree with the last extension replaced."""
    return F.concat(F.regexp_replace(relative, r"\.[^./\\]*$", ""), F.lit(extension))


def escapes_root(relative: Column) -> Column:
    """Whether a path, with `.` and `..` folded, is absolute or climbs above its root."""
    absolute = relative.rlike(r"\A([/\\]|[A-Za-z]:)")

    def step(acc: Column, segment: Column) -> Column:
        depth = F.when(segment == "..", acc["depth"] - 1).when(segment.isin("", "."), acc["depth"]).otherwise(acc["depth"] + 1)
        return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))
    lowest = F.aggregate(F.split(relative, SEPARATOR), start, step, lambda acc: acc["lowest"])
    return absolute | (lowest < 0)


def path_depth(relative: Column) -> Column:
    """Number of folders above the file."""
    return F.size(F.filter(F.split(relative, SEPARATOR), lambda s: s != "")) - 1


def windows_safe_segment(segment: Column) -> Column:
    """Legal as one Windows file or folder name."""
    # Characters and device names that Windows reserves.
    bad_tail = segment.rlike(r"[ .]\z")
    bad_char = segment.rlike(r'[\x00-\x1f<>:"/\\|?*]')
    reserved = segment.rlike(r"(?i)\A(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^.]*)?\z")
    return ~(bad_tail | bad_char | reserved)


def windows_safe_path(relative: Column, limit: int = 240) -> Column:
    segments = F.filter(F.split(relative, SEPARATOR), lambda s: s != "")
    return F.forall(segments, windows_safe_segment) & (F.length(relative) <= limit)


def path_order(path: Column) -> list[Column]:
    """Sort keys: ignoring case first, exact text to break ties."""
    return [F.lower(path).asc(), path.asc()]
