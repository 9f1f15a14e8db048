"""PII surrogates, in DataFrame operations only.

Entities are found by one pattern.  Each gets a keyed replacement of its own type:
a digest of (key, type, canonical form, attempt) chooses its letters and digits,
poured into the format of the mention (case, separators, leading country or issuer
digit, Luhn validity).  Names after an honorific keep its gender and their script.
One canonical form has one surrogate everywhere, however it is written, so mentions
that agree still agree.  All distinct entities are checked together: a surrogate
that two of them share, or that is itself an entity of the corpus, is made again
with the next attempt, until none is left.  Surrogate names get a syllable more with
each attempt, so any number of distinct names finds room; the other types keep their
length, and more entities than a format has forms are an error.

Only documents with entities are written in between; the others pass through.
Mentions are reduced to the distinct entities of a document before any shuffle by
entity, and each document gets the surrogates of its own entities.

Defined cases.  Null text stays null and has no entity; empty texts likewise.
Repeated rows get the same surrogates.  doc_id is not read, so nulls, ties and
repeats in it don't matter.  Other columns pass through; n_entities and n_distinct
are replaced if there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Stage, table

# Honorifics by gender and script.
HONORIFICS = {
    ("m", "latin"): ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("m", "cyrillic"): ["Господин", "г-н"],
    ("f", "cyrillic"): ["Госпожа", "г-жа"],
    ("m", "greek"): ["Κύριος", "κ."],
    ("f", "greek"): ["Κυρία", "κα"],
}
# Syllables that surrogate names are made of, and endings by gender.
SYLLABLES = {
    "latin": "ba del fi gor han jo kel lu mar ne pol ri san tor vi wen".split(),
    "cyrillic": "ба дел фи гор хан жо кел лу мар не пол ри сан тор ви вен".split(),
    "greek": "βα δελ φι γορ χαν ζο κελ λου μαρ νε πολ ρι σαν τορ βι ρεν".split(),
}
ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("m", "cyrillic"): "ий", ("f", "cyrillic"): "а", ("m", "greek"): "ος", ("f", "greek"): "α"}

_TITLES = "|".join(t.replace(".", r"\.") for ts in HONORIFICS.values() for t in ts)
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
# Patterns by type, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{8,}",
    "access": r"(?<![A-Za-z0-9])(?i:AKIA|ASIA)[0-9A-Za-z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": NAME,
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every match of FOUND holds one of these: a text without them is clean.
HINT = rf"[@0-9]|(?i:AKIA|ASIA)[0-9A-Za-z]{{16}}|{_TITLES}"
ROUNDS = 20
# How many leading characters of a canonical form are kept.
KEPT = {"access": 4, "iban": 2, "phone": 1, "card": 1}


def entity_type(raw: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(raw, F.lit(f"^(?:{p})$")), F.lit(t)) for t, p in PATTERNS.items()], F.lit("name"))


def secret_value(raw: Column) -> Column:
    return F.regexp_extract(raw, r"([A-Za-z0-9_/+-]{8,})$", 1)


def name_words(raw: Column) -> Column:
    """Words after the honorific: [surname] or [given, surname]."""
    return F.split(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""), " ")


def gender_script(raw: Column) -> tuple[Column, Column]:
    female = "|".join(t.replace(".", r"\.") for (g, _), ts in HONORIFICS.items() for t in ts if g == "f")
    gender = F.when(F.rlike(raw, F.lit(rf"^(?:{female})\.? ")), "f").otherwise("m")
    last = F.element_at(name_words(raw), -1)
    script = F.when(F.rlike(last, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(last, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
    return gender, script


def entities_of(raw: Column) -> Column:
    """Array of (type, canon) of a mention: one, or two for a full name."""
    kind = entity_type(raw)
    plain = F.when(kind.isin("email", "ip"), F.lower(raw)).when(kind == "secret", secret_value(raw)).otherwise(F.lower(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")))
    words, (gender, script) = name_words(raw), gender_script(raw)
    surname = F.struct(F.concat(F.lit("surname-"), script).alias("type"), F.lower(F.element_at(words, -1)).alias("canon"))
    given = F.struct(F.concat(F.lit("given-"), gender, F.lit("-"), script).alias("type"), F.lower(F.element_at(words, 1)).alias("canon"))
    named = F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("type"), plain.alias("canon"))))


def _number(i: Column) -> Column:
    return F.element_at("nums", i + 1)


def lettered(chars: Column, kept: Column) -> Column:
    """Each digit by a digit and each letter by one of `letters`, from `kept` on."""
    letter = lambda i: F.substring(F.col("letters"), _number(i) % F.length("letters") + 1, F.lit(1))
    turned = F.transform(
        chars,
        lambda c, i: F.when(i < kept, c)
        .when(c.between("0", "9"), (_number(i) % 10).cast("string"))
        .when(c.between("a", "z"), letter(i))
        .when(c.between("A", "Z"), F.upper(letter(i)))
        .otherwise(c),
    )
    return F.array_join(turned, "")


def luhn(digits: str, n: str) -> Column:
    """The Luhn sum of a column of digits with the length column `n`, modulo 10."""
    value = lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((F.col(n) - i) % 2 == 0, value(c) * 2 - F.when(value(c) > 4, 9).otherwise(0)).otherwise(value(c)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def with_made(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, attempt) with `made`, the canonical form of the replacement.
    Every step is a column of its own, so nothing is worked out twice."""
    kind, canon, columns = F.col("type"), F.col("canon"), entities.columns
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, F.col("attempt").cast("string"))
    blocks = F.sequence(F.lit(0), F.ceil(F.length(canon) / 32).cast("int"))
    out = entities.withColumn("hexed", F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 512)), ""))
    syllables_most = 4 + ROUNDS  # of a surname at the last attempt; `hexed` has at least 64 numbers
    each = F.sequence(F.lit(0), F.greatest(F.length(canon), F.lit(syllables_most)))
    out = out.withColumn("nums", F.transform(each, lambda i: F.conv(F.substring(F.col("hexed"), i * 4 + 1, F.lit(4)), 16, 10).cast("int")))
    hexes = (kind == "hex") | ((kind == "secret") & F.rlike(canon, F.lit("^[0-9a-fA-F]+$")))
    out = out.withColumn("letters", F.when(hexes, "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz"))
    kept = reduce(lambda so_far, kv: F.when(kind == kv[0], kv[1]).otherwise(so_far), KEPT.items(), F.lit(0))
    out = out.withColumn("plain", lettered(F.split(F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(canon), ""), kept))
    # cards: the last digit makes the sum valid just if it was
    out = out.withColumns({"n": F.length("plain"), "zero": F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit("0"))})
    is_card = kind == "card"
    out = out.withColumns({"check": F.when(is_card, (10 - luhn("zero", "n")) % 10), "valid": F.when(is_card, luhn("canon", "n") == 0), "last": F.when(is_card, F.expr("try_cast(right(plain, 1) AS int)"))})
    last = F.when(F.col("valid"), F.col("check")).when(F.col("last") == F.col("check"), (F.col("check") + 1) % 10).otherwise(F.col("last"))
    # addresses: the local part in its format, the domain by a digest of its own, under a name reserved for examples
    host = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    octet = lambda o, i: F.when(F.length(o) == 1, _number(i) % 10).when(F.length(o) == 2, 10 + _number(i) % 90).otherwise(100 + _number(i) % 156).cast("string")
    made = (
        F.when(kind == "email", F.concat(F.col("plain"), F.lit("@h"), F.substring(host, 1, 10), F.lit(".example."), F.when(F.substring(host, 11, 1) < "8", "org").otherwise("net")))
        .when(kind == "ip", F.array_join(F.transform(F.split(canon, r"\."), octet), "."))
        .when(is_card, F.concat(F.expr("left(plain, length(plain) - 1)"), last.cast("string")))
    )
    for script, syllables in SYLLABLES.items():
        pool = F.array(*[F.lit(x) for x in syllables])
        # 16 times the names with each attempt
        stem = lambda n, pool=pool: F.array_join(F.transform(F.slice("nums", F.lit(1), F.col("attempt") + n), lambda x: F.element_at(pool, x % 16 + 1)), "")
        made = made.when(kind == f"surname-{script}", stem(4))
        for gender in "mf":
            made = made.when(kind == f"given-{gender}-{script}", F.concat(stem(3), F.lit(ENDINGS[gender, script])))
    return out.withColumn("made", made.otherwise(F.col("plain"))).select(*columns, "made")


def poured(raw: Column, new: Column) -> Column:
    """The letters and digits of `new`, one by one, in the format and case of `raw`."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def step(acc, c):
        mine = F.substring(new, acc["k"], F.lit(1))
        cased = F.when(F.rlike(c, F.lit("^[A-Z]$")), F.upper(mine)).otherwise(mine)
        used = F.rlike(c, F.lit("^[A-Za-z0-9]$"))
        return F.struct(F.when(used, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.concat(acc["out"], F.when(used, cased).otherwise(c)).alias("out"))

    return F.aggregate(F.split(raw, ""), start, step, lambda acc: acc["out"])


def cased_like(raw: Column, new: Column) -> Column:
    return F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(new)).otherwise(new)


def replaced(raw: Column, made: Column) -> Column:
    """The text that stands for a mention; `made` maps "type|canon" to surrogates."""
    of = lambda e: F.element_at(made, F.concat_ws("|", e["type"], e["canon"]))
    kind, last = entity_type(raw), F.element_at(entities_of(raw), -1)
    title = F.regexp_extract(raw, rf"^((?:{_TITLES})\.? )", 1)
    names = F.array_join(F.transform(entities_of(raw), lambda e: F.initcap(of(e))), " ")
    return (
        F.when(kind == "name", F.concat(title, names))
        .when(kind.isin("email", "ip"), cased_like(raw, of(last)))
        .when(kind == "secret", F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(secret_value(raw))), of(last)))
        .otherwise(poured(raw, of(last)))
    )


def made_apart(entities: DataFrame, key: str, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    """(type, canon, made): a surrogate for each entity, no two of a type alike and
    none an entity itself.  Only a count comes to the driver."""
    now = stage.write(with_made(entities.withColumn("attempt", F.lit(0)), key), "made-0")
    for i in range(1, rounds):
        # who had the surrogate before keeps it; then the order is that of a keyed digest
        rank = F.row_number().over(Window.partitionBy("type", "made").orderBy("attempt", F.sha2(F.concat(F.lit(key), "canon"), 256)))
        real = entities.select("type", F.col("canon").alias("made"), F.lit(True).alias("real"))
        judged = now.withColumn("rank", rank).join(real, ["type", "made"], "left")
        judged = stage.write(judged.select("type", "canon", "attempt", "made", ((F.col("rank") > 1) | F.col("real").isNotNull()).alias("again")), f"judged-{i}")
        if not judged.where("again").limit(1).count():
            return judged.select("type", "canon", "made")
        more = with_made(judged.where("again").select("type", "canon", (F.col("attempt") + 1).alias("attempt")), key)
        now = stage.write(judged.where("NOT again").select("type", "canon", "attempt", "made").unionByName(more), f"made-{i}")
    raise RuntimeError("surrogates still collide: their formats leave too few forms")


def with_surrogates(spark: SparkSession, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with `text` rewritten, n_entities (mentions) and n_distinct (entities)."""
    stage = Stage(spark, "surrogates")
    columns = [c for c in docs.columns if c not in ("n_entities", "n_distinct")]
    docs = docs.select(*columns)
    hint = F.coalesce(F.rlike(F.col(text), F.lit(HINT)), F.lit(False))
    mentions = F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0))
    hits = docs.where(hint).withColumn("__raw", mentions).where(F.size("__raw") > 0)
    hits = stage.write(hits.withColumns({"__row": F.monotonically_increasing_id(), "__parts": F.split(F.col(text), FOUND)}).drop(text), "hits")
    clean = docs.where(~hint | (F.coalesce(F.rlike(F.col(text), F.lit(FOUND)), F.lit(False)) == F.lit(False)))

    each = hits.select("__row", F.explode(F.flatten(F.transform("__raw", entities_of))).alias("e")).select("__row", "e.type", "e.canon")
    entities = stage.write(each.select("type", "canon").distinct(), "entities")
    made = made_apart(entities, key, stage)
    told = each.distinct().join(made, ["type", "canon"])
    told = told.select("__row", F.struct(F.concat_ws("|", "type", "canon").alias("key"), "made").alias("e"))
    told = told.groupBy("__row").agg(F.map_from_entries(F.collect_list("e")).alias("__made"))
    hits = hits.join(told, "__row")
    new = F.transform("__raw", lambda m: replaced(m, F.col("__made")))
    whole = F.array_join(F.zip_with(F.col("__parts"), F.concat(new, F.array(F.lit(""))), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    counted = {"n_entities": F.size("__raw").cast("long"), "n_distinct": F.size(F.array_distinct(F.flatten(F.transform("__raw", entities_of)))).cast("long")}
    done = hits.withColumns({text: whole, **counted}).select(*columns, *counted)
    return done.unionByName(clean.withColumns({n: F.lit(0).cast("long") for n in counted}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(spark, docs, "corpusloom-demonstration-key")
