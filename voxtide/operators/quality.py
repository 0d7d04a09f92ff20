"""Data-quality rules over manifest tables. Every rule set yields ``(key, rule)`` rows for violations only.

Fixtures have one row per recording, utterances and silences one row per entry; a fixture of any length is therefore
checked row by row and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.paths import escapes_root, path_depth
from voxtide.functions.scalars import is_finite
from voxtide.functions.text import is_blank, is_sha256, normalize_text
from voxtide.operators.intervals import check_sequence
from voxtide.operators.ordered import BLOCK, block_of, blocked_by, previous_row
from voxtide.options import SAMPLE_RATE

# Fixed values of the corpus contract.
MANIFEST_VERSIONS = (2, 3)
UTTERANCE_SAMPLES = (5 * SAMPLE_RATE, 10 * SAMPLE_RATE)
GAP_SAMPLES = (SAMPLE_RATE * 3 // 4, 3 * SAMPLE_RATE)
EDGE_SAMPLES = (0, 2 * SAMPLE_RATE)
SECONDS_TOLERANCE = 1e-6
BANDS = {"short": (34.0, 55.0), "medium": (58.0, 86.0), "long": (82.0, 116.0)}
DEPTHS = (1, 2, 3)


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule, all rules in one pass. A condition that is null counts as broken."""
    broken = [F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]
    return df.select(*key, F.explode(F.filter(F.array(*broken), lambda r: r.isNotNull())).alias("rule"))


def header_rules(header: DataFrame) -> DataFrame:
    """Version, PCM contract and tolerance of manifests: one row per manifest."""
    return violations(
        header,
        ["manifest_id"],
        {
            "version": ~F.col("schema_version").isin(*MANIFEST_VERSIONS),
            "generator version": is_blank(F.col("generator_version")),
            "pcm format": (F.col("sample_rate") != SAMPLE_RATE) | (F.col("channels") != 1) | (F.col("bits_per_sample") != 16),
            "tolerance": F.col("tolerance_ms") < 0,
            "no fixtures": F.col("fixture_count") <= 0,
        },
    )


def duplicate_values(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Values that several rows share, ignoring case; counted before anything is joined."""
    return (
        df.groupBy(F.lower(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
        .select("value", "rows", F.lit(rule).alias("rule"))
    )


def fixture_rules(fixtures: DataFrame, utterances: DataFrame, block_size: int | None = None) -> DataFrame:
    """Per-fixture provenance rules and the order and bounds of the expected intervals."""
    counts = utterances.groupBy("file_id").agg(F.count(F.lit(1)).alias("_utterances"))
    relative = lambda c: is_blank(F.col(c)) | escapes_root(F.col(c))
    rows = fixtures.join(counts, "file_id", "left")
    simple = violations(
        rows,
        ["file_id"],
        {
            "duration": F.col("total_samples") <= 0,
            "flat path": relative("flat_path"),
            "nested path": relative("nested_path"),
            "vtt path": relative("vtt_path"),
            "file hash": ~is_sha256(F.col("file_sha")),
            "pcm hash": ~is_sha256(F.col("pcm_sha")),
            "no utterances": F.coalesce(F.col("_utterances"), F.lit(0)) < 1,
        },
    )
    broken = check_sequence(utterances, fixtures.select("file_id", "total_samples"), block_size)
    return simple.unionByName(broken.select("file_id", F.concat(F.lit("utterance "), "rule").alias("rule")).distinct())


def text_rules(utterances: DataFrame, normalized: bool = False) -> DataFrame:
    """Authored text present and its stored normal form right."""
    return violations(
        utterances,
        ["file_id", "idx"],
        {
            "blank text": is_blank(F.col("text")) | is_blank(F.col("normalized_text")),
            "normalized text": normalize_text(F.col("text"), normalized) != F.col("normalized_text"),
        },
    )


def ground_truth_rules(fixtures: DataFrame, utterances: DataFrame, block_size: int | None = None) -> DataFrame:
    """Silences and utterances tile each recording: ``utterances`` carry the silence before them, ``fixtures`` the
    trailing one."""
    rows, block = blocked_by(utterances, ["file_id"], block_of(F.col("idx"), block_size or BLOCK), force=bool(block_size))
    rows = previous_row(rows, ["file_id"], block, ["idx"], ["end_sample"], "_prev")
    length = F.col("end_sample") - F.col("start_sample")
    first = F.col("idx") == 0
    gap = F.col("gap_before")
    low, high = UTTERANCE_SAMPLES
    seconds = lambda s, n: F.abs(F.col(s) - F.col(n) / float(SAMPLE_RATE)) > SECONDS_TOLERANCE
    per_row = violations(
        rows,
        ["file_id", "idx"],
        {
            "tiling": F.col("start_sample") != F.coalesce(F.col("_prev.end_sample"), F.lit(0)) + gap,
            "utterance length": (length < low) | (length > high),
            "leading silence": first & ((gap < EDGE_SAMPLES[0]) | (gap > EDGE_SAMPLES[1])),
            "gap": ~first & ((gap < GAP_SAMPLES[0]) | (gap > GAP_SAMPLES[1])),
            "seconds": seconds("start_seconds", "start_sample") | seconds("end_seconds", "end_sample"),
        },
    )
    ends = utterances.groupBy("file_id").agg(F.max("end_sample").alias("_end"), F.count(F.lit(1)).alias("_n"))
    trailing = F.col("trailing_silence")
    per_file = violations(
        fixtures.join(ends, "file_id", "left"),
        ["file_id"],
        {
            "trailing silence": (trailing < EDGE_SAMPLES[0]) | (trailing > EDGE_SAMPLES[1]),
            "fill": F.coalesce(F.col("_end"), F.lit(0)) + trailing != F.col("total_samples"),
            "too few utterances": F.coalesce(F.col("_n"), F.lit(0)) < 2,
            "duration": ~is_finite(F.col("target_seconds")) | (F.col("target_seconds") <= 0),
        },
    )
    return per_row.unionByName(per_file.select("file_id", F.lit(None).cast(rows.schema["idx"].dataType).alias("idx"), "rule"))


def coverage_rules(fixtures: DataFrame, per_band: int, path: str = "nested_path") -> DataFrame:
    """Corpus coverage: band sizes and ranges, every folder depth, names with spaces and beyond ASCII.

    One aggregation to a single row; each broken rule then becomes a row.
    """
    band, target = F.col("band"), F.col("target_seconds")
    folder_depth = path_depth(F.col(path)) - 1
    checks = [F.count_if(band == name).alias(f"n_{name}") for name in BANDS]
    checks += [F.count_if((band == name) & ~target.between(low, high)).alias(f"bad_{name}") for name, (low, high) in BANDS.items()]
    checks += [F.count_if(folder_depth == d).alias(f"depth_{d}") for d in DEPTHS]
    checks += [
        F.count_if(~F.coalesce(band.isin(*BANDS), F.lit(False))).alias("unknown_band"),
        F.count_if(~folder_depth.isin(*DEPTHS)).alias("bad_depth"),
        F.count_if(F.contains(F.col(path), F.lit(" "))).alias("spaces"),
        F.count_if(F.col(path).rlike(r"[^\x00-\x7F]")).alias("beyond_ascii"),
    ]
    rules = {f"{name} band size": F.col(f"n_{name}") != per_band for name in BANDS}
    rules |= {f"{name} band range": F.col(f"bad_{name}") > 0 for name in BANDS}
    rules |= {f"depth {d} missing": F.col(f"depth_{d}") == 0 for d in DEPTHS}
    rules |= {
        "unknown band": F.col("unknown_band") > 0,
        "depth out of range": F.col("bad_depth") > 0,
        "no name with a space": F.col("spaces") == 0,
        "no name beyond ascii": F.col("beyond_ascii") == 0,
    }
    return violations(fixtures.agg(*checks), [], rules)


def split_quarantine(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their one reason."""
    return scanned.filter("error IS NULL").drop("error"), scanned.filter("error IS NOT NULL")
