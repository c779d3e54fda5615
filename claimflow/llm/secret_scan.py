"""Secret scans: fixed patterns and a Markov test of long tokens.

Three patterns find the usual secrets. Beyond them every long token of the
corpus is judged by two first-order character models, of random strings and
of ordinary identifiers: the log-likelihood ratio of its transitions tells
which of the two made it. Both models are trained from a fixed labelled
sample that Spark derives from numbers: random strings over the usual
alphabets from digests, and identifiers in the usual styles (with digits,
paths, dates and versions) from common words. So the verdict on a token
depends on the token alone, not on its corpus. Only DataFrame functions run.

Scale: one pass over the texts turns them into narrow rows, one per match
(and one per document); everything after works on those. Prefix sums of the
gaps between matches give positions, one window per document, so cost is
linear in the matches. The ratios are 66 x 66 numbers that every task gets
with its plan, so judging a token takes no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import materialise

# Fixed values of the contract, in its order: kind, pattern, the group whose
# length counts, and that length.
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Kind and pattern of the tokens that the models judge.
TOKEN = ("random", r"[A-Za-z0-9+/_-]{16,}")
KINDS = tuple(kind for kind, *_ in BASE) + TOKEN[:1]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Mean log-likelihood ratio of a transition, in thousandths of a nat, that makes a token random.
MIN_RATIO = 200
#: The share of a model's single-character probabilities in those of its transitions.
BACKOFF = 0.1
#: Digests in the labelled sample, each written in several alphabets, and identifiers, each in several styles.
SAMPLE_DIGESTS, SAMPLE_NAMES = 2000, 4000
# Common words of identifiers and of four languages that the labelled identifiers are made of.
WORDS = (
    "get set is has max min user account name file path read write open close start stop list index count size buffer "
    "default config option value key string number error handler request response server client host port connection time "
    "date update create delete remove test data model view page image report item order customer address message event "
    "cache session thread process service manager factory builder parser format version build release source target local "
    "share lib python java script style common internal public static install package module class function method "
    "the and with from that this which would there their international information government development "
    "die der und nicht eine schaft keit lich heit ung ver sich wissenschaft versicherung arbeit gesellschaft "
    "les des une est pour dans que avec tion ment eau eux aux entreprise maintenant toujours "
    "los las una del para por con cion mente ado ido empresa siempre entonces trabajo")


def _matches(text: Column, no: int, pattern: str, group: int) -> Column:
    """For each match: kind, code points since the match before, the match, and the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), groups.alias("part")),
        lambda m: F.struct(F.lit(no).alias("kind"), m["gap"].alias("gap"), m["match"].alias("match"), m["part"].alias("part")))
    # As many code points as needed must be there for any of the work.
    return F.when(F.rlike(text, F.lit(pattern)), whole)


def find_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kind, start, end, match, part): a row for each match, or one with a null kind for a text without.

    Kinds are numbers into ``KINDS``. Matches that are too short stay, as they
    take part in the leftmost non-overlapping order.
    """
    # A run of hex digits is matched whole or not at all, so its length can be part of the pattern.
    patterns = [(p if kind != "hex" else p[:-1] + f"{{{least},}}", group) for kind, p, group, least in BASE]
    patterns.append((TOKEN[1], 0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = [F.coalesce(_matches(F.col("text"), no, p, group), F.array().cast(
        "array<struct<kind:int,gap:int,match:string,part:string>>")) for no, (p, group) in enumerate(patterns)]
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "id", F.posexplode_outer(F.concat(*lists)).alias("pos", "m"))
        .select("row", "id", "pos", "m.*")
    )
    length = F.char_length("match")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.repartition("row")
        .withColumn("end", F.sum((F.col("gap") + length).cast("long")).over(upto))
        .select("row", "id", "kind", (F.col("end") - length).alias("start"), "end", "match", "part")
    )


def _accepted() -> Column:
    """Whether a match of a base kind is long enough."""
    out = F.lit(False)
    for no, (_, _, _, least) in enumerate(BASE):
        out = F.when(F.col("kind") == no, F.char_length("part") >= least).otherwise(out)
    return out


def mark_free(spans: DataFrame) -> DataFrame:
    """Adds ``base`` (an accepted base match) and ``free`` (a token that overlaps none)."""
    row = Window.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(row.rowsBetween(0, Window.unboundedFollowing))
    # Matches that start together may be sorted before or after the token.
    apart = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return (
        spans.withColumn("base", F.coalesce(_accepted(), F.lit(False)))
        .withColumn("free", (F.col("kind") == len(BASE)) & apart)
        .withColumn("free", F.coalesce("free", F.lit(False)))
    )


def labelled_samples(frame: DataFrame) -> DataFrame:
    """(s, random): the labelled strings, the same in every corpus; ``frame`` names the session only.

    Random: digests in base 64 of both kinds, base 62, hex of both cases, base
    36 and letters alone. Ordinary: two to four of ``WORDS`` as snake, kebab
    and camel case, as constants, paths and words run together, some with
    numbers, versions and dates, and dates alone.
    """
    spark = frame.sparkSession
    number = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("sample "), number), 256)
    based = F.base64(F.unhex(digest))
    letters = F.translate(based, "0123456789+/=", "qRsTuVwXyZkM")
    random = spark.range(SAMPLE_DIGESTS).select(F.explode(F.array(
        F.translate(based, "=", ""), F.translate(based, "+/=", "-_"), F.translate(based, "+/=", "Xy"), letters, digest,
        F.upper(digest), F.conv(F.substring(digest, 1, 15), 16, 36), F.lower(F.conv(F.substring(digest, 1, 15), 16, 36)))).alias("s"))

    words = F.split(F.lit(WORDS), " ")

    def draw(k: int, below) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), below)

    parts = F.array(*[F.element_at(words, (draw(k, F.size(words)) + 1).cast("int")) for k in range(4)])
    parts = F.slice(parts, 1, (draw(9, F.lit(3)) + 2).cast("int"))
    n, year = draw(10, F.lit(100)).cast("string"), (draw(11, F.lit(60)) + 1970).cast("string")
    month, day = (F.lpad((draw(k, F.lit(top)) + 1).cast("string"), 2, "0") for k, top in ((12, 12), (13, 28)))
    join = lambda sep: F.array_join("parts", sep)
    camel = F.array_join(F.transform("parts", lambda w, k: F.when(k == 0, w).otherwise(F.initcap(w))), "")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    ordinary = spark.range(SAMPLE_NAMES).withColumn("parts", parts).select(F.explode(F.array(
        join("_"), join("-"), camel, F.initcap(camel), F.upper(join("_")), join("/"), join(""), F.initcap(join("")),
        text("/", join("/"), n), text(join("_"), "_", n), text(join("-"), "-", n, "-", year), text(camel, n),
        text(join("/"), "/", year, "/", month, "/", join("-")), text(year, "-", month, "-", day, "/", year, "-12-31"),
        text(year, "/", month, "/", day, "/", join("_")), text(year, month, day, "_", join("_")), text(join("-"), "-v", n),
        text(F.upper(join("-")), "-", n), text("/", join("/"), "/", n, "/", year))).alias("s"))
    return random.distinct().withColumn("random", F.lit(True)).union(ordinary.distinct().withColumn("random", F.lit(False)))


def _transitions(strings: DataFrame) -> DataFrame:
    """A row for each pair of neighbouring characters of the alphabet in column s."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("s") - 1))
    return (
        strings.where(F.char_length("s") >= 2).withColumn("at", at)
        .withColumns({"a": F.substring("s", F.col("at"), F.lit(1)), "b": F.substring("s", F.col("at") + 1, F.lit(1))})
        .drop("at")
    )


def train(samples: DataFrame) -> DataFrame:
    """(a, b, ratio) for all pairs of the alphabet: log of P(b after a | random) / P(b after a | ordinary), in thousandths.

    A pair's probability has a share ``BACKOFF`` of that of its second
    character, so unseen pairs of a model tell as much as its characters do.
    Without samples every ratio is 0.
    """
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    grid = samples.sparkSession.range(1).select(F.explode(letters).alias("a")).select("a", F.explode(letters).alias("b"))
    counts = _transitions(samples).groupBy("a", "b").agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o"))
    full = grid.join(counts, ["a", "b"], "left").na.fill(0, ["r", "o"])  # always 66 x 66 rows
    before, after, every = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy()

    def chance(c: str) -> Column:
        single = (F.sum(c).over(after) + 0.5) / (F.sum(c).over(every) + 0.5 * len(ALPHABET))
        pair = F.col(c) / F.greatest(F.sum(c).over(before), F.lit(1))
        return (1 - BACKOFF) * pair + BACKOFF * single

    return full.select("a", "b", F.round(1000 * F.log(chance("r") / chance("o"))).cast("long").alias("ratio"))


def is_random(token: Column, model: DataFrame, min_ratio: int = MIN_RATIO) -> Column:
    """Whether the mean log-likelihood ratio of a string's transitions reaches ``min_ratio``.

    The model's 66 x 66 numbers become part of the plan. Characters beyond the
    alphabet, and strings without two neighbours in it, say nothing.
    """
    size = len(ALPHABET)
    ratios = [0] * (size * size)
    for r in model.collect():  # always size * size rows
        ratios[ALPHABET.index(r.a) * size + ALPHABET.index(r.b)] = r.ratio
    table = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<long>")
    # Places in the alphabet, from 1; 0 is none.
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.filter(F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)),
                                lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * size + b)), lambda p: p.isNotNull())
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + F.element_at(table, p))
    return F.coalesce((F.size(pairs) > 0) & (total >= min_ratio * F.size(pairs)), F.lit(False))


def random_strings(strings: DataFrame, model: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """The distinct strings (column s) that are random by :func:`is_random`."""
    return strings.distinct().where(is_random(F.col("s"), model, min_ratio))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: int = MIN_RATIO) -> DataFrame:
    """One row per document: ``id_col`` and ``spans``, an array of (start, kind, end) in that order.

    ``kind`` is a number into ``KINDS``; positions are code points, end
    exclusive. Base spans are the accepted matches of the three patterns, found
    leftmost and non-overlapping per kind; ``random`` spans are long tokens
    that overlap none of them and that the models take for random.

    Defined cases: a null or empty text has no span; repeated rows, rows with
    one id and null ids each get their own row; spans that start together are
    ordered by kind; an empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    spans = materialise(mark_free(find_spans(docs, id_col, text_col)), "secret-spans")
    model = train(labelled_samples(docs))
    judged = spans.withColumn("random", F.when(F.col("free"), is_random(F.col("match"), model, min_ratio)).otherwise(F.lit(False)))
    take = F.coalesce(F.col("base"), F.lit(False)) | F.col("random")
    return judged.groupBy("row", "id").agg(F.sort_array(F.collect_list(
        F.when(take, F.struct("start", "kind", "end")))).alias("spans")).select(F.col("id").alias(id_col), "spans")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document (contract of op6)."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def of(no: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == no)).cast("long")

    counts = [of(no).alias(f"n_{kind}") for no, (kind, *_) in enumerate(BASE)]
    return scan_secrets(docs).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
