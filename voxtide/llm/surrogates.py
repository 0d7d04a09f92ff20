"""Replaces personal data in transcripts by keyed surrogates of the same form. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.session import cut_lineage

# Titles by the gender of the names that follow them.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"),
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’]+"
# Kinds of entities, the more particular first. A match is of the first kind whose pattern it fits as a whole.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{N}.+-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![\p{N}-])|(?<![\p{N}.+-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\p{N}-])",
    "address": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}])(?!\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\p{N}])|(?<![\p{N}+-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{N}])|(?<![\p{N}+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{N}-])",
    "number": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "person": rf"(?<![\p{{L}}]){_TITLE} {_NAME}(?:[ -]{_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A text without any of this has no entity: most need no more than this test.
HINT = rf"[0-9@]|[0-9A-Fa-f]{{32}}|(?<!\p{{L}}){_TITLE} \p{{Lu}}"
# Attempts to find a surrogate that is no one else's.
ATTEMPTS = 200


def kind_of(match: Column) -> Column:
    found = F.lit("person")
    for kind, pattern in reversed(PATTERNS.items()):
        # The match alone has nothing around it for the pattern to look at.
        found = F.when(match.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(found)
    return found


def units_of(kind: Column, match: Column) -> Column:
    """What is replaced as one: role and canonical form. Names word by word, the last as the family's; numbers by their digits."""
    digits = F.regexp_replace(match, r"[^0-9]", "")
    one = (
        F.when(kind.isin("card", "number"), digits)
        # Without the country code: the same line with and without it is one entity.
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind == "email", F.lower(match))
        .otherwise(F.replace(match, F.lit(" "), F.lit("")))
    )
    words = F.slice(F.split(match, "[ -]"), 2, 9)
    gender = F.when(match.rlike("^(?:" + "|".join(TITLES["f"]) + r")\b"), "given_f").otherwise("given_m")
    names = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise(gender).alias("role"), w.alias("canon")))
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("role"), one.alias("canon"))))


def _draws(key: str, role: Column, canon: Column, attempt: Column) -> Column:
    """512 hexadecimal digits that depend on the key, the entity and the attempt."""
    word = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), role, attempt.cast("string"), F.lit(str(n)), canon), 512)
    return F.concat(*[word(n) for n in range(4)])


def _at(draws: Column, i: Column, below: int) -> Column:
    """The i-th of 128 draws as a number under ``below``."""
    return (F.conv(F.substr(draws, F.pmod(i, F.lit(128)) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _pick(letters: str, draws: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _at(draws, i, len(letters)) + 1, F.lit(1))


# Letters by script, lower case then upper case; syllables of given names with their endings by gender.
SCRIPTS = (
    (r"[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя", r"[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω", r"[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{Ll}", "abcdefghijklmnopqrstuvwxyz", r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
ENDINGS = {"given_m": ("us", "ус", "ος"), "given_f": ("ia", "ия", "ία")}


def _shaped(canon: Column, draws: Column) -> Column:
    """Every letter and digit replaced by one of its kind, script and case; all else stays."""

    def one(i: Column) -> Column:
        c = F.substr(canon, i, F.lit(1))
        out = F.when(c.rlike("[0-9]"), _at(draws, i, 10).cast("string"))
        for low, lows, up, ups in SCRIPTS:
            out = out.when(c.rlike(low), _pick(lows, draws, i)).when(c.rlike(up), _pick(ups, draws, i))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), one), "")


def surrogate_of(role: Column, canon: Column, draws: Column) -> Column:
    """Surrogate of a canonical form, itself canonical."""
    shaped = _shaped(canon, draws)
    octets = F.transform(
        F.split(canon, r"\."),
        lambda o, i: F.when(F.length(o) == 3, 100 + _at(draws, i, 100)).when(F.length(o) == 2, 10 + _at(draws, i, 90)).otherwise(1 + _at(draws, i, 9)).cast("string"),
    )
    hexes = lambda digits: F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: _pick(digits, draws, i)), "")
    stem = F.left(shaped, F.greatest(F.lit(4), F.least(F.length(canon), F.lit(9)) - 2))
    given = F.lit(None).cast("string")
    for gender, endings in ENDINGS.items():
        script = F.when(canon.rlike("[а-яёА-ЯЁ]"), endings[1]).when(canon.rlike("[α-ωΑ-Ω]"), endings[2]).otherwise(endings[0])
        given = F.when(role == gender, F.concat(stem, script)).otherwise(given)
    top = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    return (
        F.when(role == "address", F.array_join(octets, "."))
        .when((role == "secret") & canon.rlike(r"\A[0-9a-f]+\z"), hexes("0123456789abcdef"))
        .when((role == "secret") & canon.rlike(r"\A[0-9A-F]+\z"), hexes("0123456789ABCDEF"))
        .when(role == "secret", F.concat(F.left(canon, F.lit(3)), F.substr(shaped, F.lit(4))))
        .when(role == "account", F.concat(F.left(canon, F.lit(2)), F.substr(shaped, F.lit(3))))
        .when(role == "email", F.concat(F.left(shaped, F.length(shaped) - F.length(top)), top))
        .when(role.startswith("given"), given)
        .otherwise(shaped)
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``role, canon`` (distinct) to ``role, canon, surrogate``: no two the same in a role, and none that occurs itself.

    Rounds of one partial aggregation and two joins: who shares a surrogate with a smaller form, or has one
    that is another's real form, draws again; the rest keep theirs.
    """
    drawn = lambda rows: rows.withColumn("surrogate", surrogate_of(F.col("role"), F.col("canon"), _draws(key, F.col("role"), F.col("canon"), F.col("attempt"))))
    now = cut_lineage(drawn(entities.select("role", "canon").withColumn("attempt", F.lit(0))))
    real = entities.select("role", F.col("canon").alias("surrogate")).withColumn("_real", F.lit(True))
    for _ in range(ATTEMPTS):
        owner = now.groupBy("role", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("_o"))
        judged = now.join(owner, ["role", "surrogate"]).join(real, ["role", "surrogate"], "left")
        lost = (F.col("_o.canon") != F.col("canon")) | F.col("_real").isNotNull()
        judged = cut_lineage(judged.select("role", "canon", "attempt", "surrogate", lost.alias("lost")))
        if judged.filter("lost").isEmpty():
            return judged.select("role", "canon", "surrogate")
        again = drawn(judged.filter("lost").select("role", "canon", (F.col("attempt") + 1).alias("attempt")))
        now = cut_lineage(judged.filter("not lost").select("role", "canon", "attempt", "surrogate").union(again.select("role", "canon", "attempt", "surrogate")))
    raise ValueError("too many entities for the forms that they may take")


def rendered(raw: Column, kind: Column, names: Column) -> Column:
    """The match with its surrogate in the match's own format: title, separators, case and country code stay."""
    first = F.get(names, F.lit(0))
    # Digits from the right, as the canonical form of a phone is its end.
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))

    def digit(c: Column, i: Column) -> Column:
        left = digits - F.length(F.regexp_replace(F.left(raw, i + 1), "[^0-9]", ""))
        place = F.length(first) - left
        return F.when(c.rlike("[0-9]") & (place > 0), F.substr(first, place, F.lit(1))).otherwise(c)

    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    numbers = F.array_join(F.transform(chars, digit), "")

    def spaced(c: Column, i: Column) -> Column:
        place = i + 1 - (F.length(F.left(raw, i + 1)) - F.length(F.replace(F.left(raw, i + 1), F.lit(" "), F.lit(""))))
        return F.when(c == " ", c).otherwise(F.substr(first, place, F.lit(1)))

    words = F.split(raw, "[ -]")
    marks = F.regexp_extract_all(raw, F.lit("[ -]"), F.lit(0))
    named = F.concat(F.get(words, F.lit(0)), F.array_join(F.transform(names, lambda n, i: F.concat(F.get(marks, i), n)), ""))
    upper = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(first)).otherwise(first)
    return (
        F.when(kind == "person", named)
        .when(kind.isin("card", "number", "phone"), numbers)
        .when(kind == "account", F.array_join(F.transform(chars, spaced), ""))
        .when(kind == "email", upper)
        .otherwise(first)
    )


def replace_entities(transcripts: DataFrame, key: str) -> DataFrame:
    """All columns of the transcripts, ``text`` with surrogates, and ``entities`` (map of kind and number of matches).

    ``file_id, text`` and any further columns; one named ``entities`` is replaced. Found are the ``PATTERNS``: e-mail and network
    addresses, phone, card, account and identity numbers, secrets, and names after a title. The same entity
    has the same surrogate in every transcript, in whatever format it is written, different entities have different ones,
    and none has one that occurs in the data; gender (by title), script, case and format stay. Without
    ``key`` the mapping cannot be computed.

    Null texts stay null, empty ones empty, both without entities. Rows are told apart by id and text, equal
    rows alike; a null id does no harm. An empty table gives no rows. An entity that a third of the
    transcripts name is one row of the entity table, reached by a join that Spark can split.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = transcripts.drop("entities")
    keyed = rows.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("file_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    hits = keyed.filter(F.col("text").rlike(HINT)).select("_key", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("at", "raw"))
    hits = hits.withColumn("kind", kind_of(F.col("raw")))
    units = cut_lineage(hits.select("_key", "at", "raw", "kind", F.posexplode(units_of(F.col("kind"), F.col("raw"))).alias("n", "u")).select("_key", "at", "raw", "kind", "n", "u.role", "u.canon"))
    known = distinct_surrogates(cut_lineage(units.select("role", "canon").distinct()), key)
    named = units.join(known, ["role", "canon"]).select("_key", F.struct("at", "n", "raw", "kind", "surrogate").alias("u"))
    # As many as one text has, equal rows once.
    per = named.groupBy("_key").agg(F.sort_array(F.collect_set("u")).alias("_u"))
    heads = F.filter("_u", lambda u: u["n"] == 0)
    per = per.select("_key", "_u", heads.alias("_heads"))
    new = F.transform("_heads", lambda h: rendered(h["raw"], h["kind"], F.transform(F.filter("_u", lambda u: u["at"] == h["at"]), lambda u: u["surrogate"])))
    count = F.map_from_arrays(
        F.array(*map(F.lit, PATTERNS)),
        F.array(*[F.size(F.filter("_heads", lambda h: h["kind"] == F.lit(k))) for k in PATTERNS]),
    )
    per = per.select(F.col("_key").alias("_k"), new.alias("_new"), count.alias("entities"))
    joined = keyed.join(per, F.col("_key") == F.col("_k"), "left")
    gaps = F.transform(F.array(F.split("text", ANY)), lambda g: F.zip_with(g, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))[0]
    none = F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.array(*[F.lit(0) for _ in PATTERNS]))
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(F.array_join(gaps, ""))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns], F.coalesce("entities", none).alias("entities"))
