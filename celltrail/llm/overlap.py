"""Same or near-same records across splits, told by their marker sets.

Records are canonicalised to sorted arrays of token hashes and collapsed to
their distinct sets first, so copies cost one row each. Equal sets meet by
their hash. Sets that share at least ``similarity`` of their union meet by
hashes of tokens from a prefix of each set: two sets that reach the threshold
have w common tokens among the first n - ceil(similarity * n) + w of each, in
any order common to all sets. The rarest tokens come first, so few sets meet in
vain; small sets meet by pairs of tokens, large ones by single tokens, as pairs
would grow with the square. Candidates are then verified exactly. No pair is
lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrail.functions.text import strip
from celltrail.llm.related import plain
from celltrail.session import cut_lineage, salted_join

SIMILARITY = 0.7
#: Sets of about this size and more meet by single tokens.
LARGE = 40


def markers_in_prompt(prompt: Column) -> Column:
    """The marker list that a question ends with, as an array of raw tokens."""
    intro = r"(?is)^.*(?:\bmarkers?\s*[:=]|\bgenes?\s*(?:->|[:=])|\bexpress(?:es|ing)?\s*:?\s|->|:)\s*"
    body = F.regexp_replace(prompt, intro, "")
    body = F.regexp_replace(body, r"(?s)[.?!](?:\s+\p{L}.*)?\s*$", "")
    return F.split(strip(body), r"(?U)[\s,;|/]+")


def marker_set(df: DataFrame) -> Column:
    """A record's markers: the original ones if present, else its own, else those in the prompt."""
    original = F.col("metadata.original_markers")
    chosen = (
        F.when(F.size(original) > 0, original)
        .when(F.size("markers") > 0, F.col("markers"))
        .otherwise(markers_in_prompt(F.col("prompt")))
    )
    cleaned = F.transform(F.coalesce(chosen, F.array()), lambda m: F.upper(strip(m)))
    return F.array_distinct(F.filter(cleaned, lambda m: m.isNotNull() & (m != "")))


def _prefix(tokens: Column, similarity: float, width: int) -> Column:
    """As many of a set's first tokens as hold ``width`` common ones with any set that is similar."""
    n = F.size(tokens)
    length = n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int") + F.lit(width)
    return F.slice(tokens, F.lit(1), F.greatest(F.least(length, n), F.lit(0)))


def _keys(tokens: Column, similarity: float) -> Column:
    """Hashes by which a set meets similar ones: pairs of tokens of its prefix if small, single ones if large, both between.

    Two similar sets differ in size by less than ``similarity``, so both are
    small, both are large, or both between.
    """
    one = F.transform(_prefix(tokens, similarity, 1), lambda t: F.xxhash64(t))
    prefix = _prefix(tokens, similarity, 2)
    at = F.sequence(F.lit(1), F.greatest(F.size(prefix), F.lit(1)))
    two = F.flatten(F.transform(at, lambda i: F.transform(F.slice(prefix, i + 1, F.size(prefix)), lambda t: F.xxhash64(F.get(prefix, i - 1), t))))
    none = F.array().cast("array<bigint>")
    n = F.size(tokens)
    return F.concat(F.when(n <= LARGE / similarity, two).otherwise(none), F.when(n >= LARGE * similarity, one).otherwise(none))


def by_rarity(sets: DataFrame) -> DataFrame:
    """``sets`` with their tokens in the order of how few sets hold them, the rarest first."""
    flat = cut_lineage(sets.select("set_id", F.explode("tokens").alias("token")))
    held = flat.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    ranked = salted_join(flat, held, "token", "inner").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("r"))
    return sets.drop("tokens").join(ranked.select("set_id", F.transform("r", lambda x: x["token"]).alias("tokens")), "set_id")


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (``left_id``, ``right_id``, ``common``, ``union_size``) of similar distinct sets.

    ``sets`` has ``set_id``, ``tokens`` (hashes, none twice, the rarest first),
    ``is_left`` and ``is_right``; a set may be on both sides and then pairs with
    itself. Keys that very many sets share are salted.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")

    def side(flag: str, name: str) -> DataFrame:
        # A set of one token equals another or differs by half; pairs of tokens need two common ones.
        held = sets.where(F.col(flag) & (F.size("tokens") >= 2))
        keys = F.explode(F.array_distinct(_keys(F.col("tokens"), similarity)))
        return held.select(F.col("set_id").alias(f"{name}_id"), F.size("tokens").alias(f"n_{name}"), keys.alias("key"))

    candidates = (
        salted_join(side("is_left", "left"), side("is_right", "right"), "key", "inner")
        .where(F.least("n_left", "n_right") >= F.greatest("n_left", "n_right") * similarity - 1e-9)
        .where("left_id != right_id")
        .select("left_id", "right_id")
        .distinct()
    )
    tokens = sets.select("set_id", "tokens")
    common = F.size(F.array_intersect("a", "b"))
    verified = (
        candidates.join(tokens.select(F.col("set_id").alias("left_id"), F.col("tokens").alias("a")), "left_id")
        .join(tokens.select(F.col("set_id").alias("right_id"), F.col("tokens").alias("b")), "right_id")
        .select("left_id", "right_id", common.alias("common"), (F.size("a") + F.size("b") - common).alias("union_size"))
        .where(F.col("common") >= F.col("union_size") * similarity - 1e-9)
    )
    same = sets.where("is_left and is_right").select(
        F.col("set_id").alias("left_id"),
        F.col("set_id").alias("right_id"),
        F.size("tokens").alias("common"),
        F.size("tokens").alias("union_size"),
    )
    return verified.unionByName(same)


def split_overlaps(
    examples: DataFrame, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, set pairs and distinct sets of the records that evaluation and training share.

    Needs ``example_id``, ``split``, ``source``, ``markers``, ``prompt`` and
    ``metadata.original_markers``. Records with an empty marker set (all three
    places null, empty or blank) match nothing. Rows whose split is none of
    train, validation and test are left out. Copies stay grouped: members are
    (``set_id``, ``example_id``, ``split``, ``source``), pairs join set ids.
    """
    side = F.lower(strip(F.col("split")))
    read = (
        examples.select("example_id", side.alias("split"), "source", marker_set(examples).alias("m"))
        .where(F.col("split").isin("train", "validation", "test") & (F.size("m") > 0))
        .select(
            "example_id", "split", "source", F.array_sort(F.transform("m", lambda t: F.xxhash64(t))).alias("tokens")
        )
        .withColumn("digest", F.unhex(F.md5(F.array_join(F.transform("tokens", lambda t: F.hex(t)), ""))))
    )
    read = cut_lineage(read)
    sets = read.groupBy("digest").agg(
        F.first("tokens").alias("tokens"),
        F.max(F.col("split") != "train").alias("is_left"),
        F.max(F.col("split") == "train").alias("is_right"),
    )
    # Short numbers in place of digests keep the join's rows small; the checkpoint fixes them.
    sets = cut_lineage(sets.withColumn("set_id", F.monotonically_increasing_id()))
    members = salted_join(read.drop("tokens"), sets.select("digest", "set_id"), "digest", "inner").drop("digest")
    return members, similar_sets(cut_lineage(by_rarity(sets.drop("digest"))), similarity), sets


def overlap_pairs(examples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each pair of one training and one evaluation record whose sets are similar."""
    members, pairs, _ = split_overlaps(examples, similarity)
    members = cut_lineage(members.select("set_id", "example_id", "split"))
    held = members.where("split != 'train'").select(F.col("set_id").alias("left_id"), F.col("example_id").alias("e"))
    train = members.where("split = 'train'").select(F.col("set_id").alias("right_id"), F.col("example_id").alias("t"))
    met = salted_join(held, pairs.select("left_id", "right_id"), "left_id", "inner")
    # Training copies of a set are the many; they are salted, the evaluation records repeated.
    return (
        salted_join(train, met, "right_id", "inner")
        .select(F.least("e", "t").alias("example_id_1"), F.greatest("e", "t").alias("example_id_2"))
        .where("example_id_1 < example_id_2")
        .distinct()
    )


def _named_sets(members: DataFrame) -> DataFrame:
    """(``set_id``, ``rep``, ``l``, ``r``): each set's smallest record, and its records in evaluation and training."""
    return cut_lineage(
        members.groupBy("set_id").agg(
            F.min("example_id").alias("rep"), F.count_if(F.col("split") != "train").alias("l"), F.count_if(F.col("split") == "train").alias("r")
        )
    )


def overlap_members(examples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(``example_id``, ``split``, ``set_id``, ``others``): each record in an overlap, the smallest record with its set, and how many similar sets the other side has.

    Together with ``overlap_sets`` this says all that ``overlap_pairs`` says, in a row a record.
    """
    members, pairs, _ = split_overlaps(examples, similarity)
    members, pairs = cut_lineage(members.select("set_id", "example_id", "split")), cut_lineage(pairs)
    left = pairs.groupBy(F.col("left_id").alias("set_id")).agg(F.count(F.lit(1)).alias("others")).withColumn("_train", F.lit(False))
    right = pairs.groupBy(F.col("right_id").alias("set_id")).agg(F.count(F.lit(1)).alias("others")).withColumn("_train", F.lit(True))
    linked = left.unionByName(right).join(_named_sets(members).select("set_id", "rep"), "set_id")
    linked = linked.select(F.concat_ws(":", "set_id", "_train").alias("_side"), "rep", "others")
    sided = members.select("example_id", "split", F.concat_ws(":", "set_id", F.col("split") == "train").alias("_side"))
    return salted_join(sided, linked, "_side", "inner").select("example_id", "split", F.col("rep").alias("set_id"), "others")


def overlap_sets(examples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(``left_id``, ``right_id``, ``common``, ``union_size``, ``left_records``, ``right_records``): similar sets of evaluation and training with their records.

    A set is named by the smallest record that has it.
    """
    members, pairs, _ = split_overlaps(examples, similarity)
    named = _named_sets(members)
    left = named.select(F.col("set_id").alias("left_id"), F.col("rep").alias("_l"), F.col("l").alias("left_records"))
    right = named.select(F.col("set_id").alias("right_id"), F.col("rep").alias("_r"), F.col("r").alias("right_records"))
    return pairs.join(left, "left_id").join(right, "right_id").select(
        F.col("_l").alias("left_id"), F.col("_r").alias("right_id"), "common", "union_size", "left_records", "right_records"
    )


def overlap_counts(examples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per evaluation split and source: records, those found in training, and those found exactly.

    Sources are compared without case, punctuation and blanks; a record with
    several (split at ``;``) counts for each, one without for ``none``.
    """
    members, pairs, _ = split_overlaps(examples, similarity)
    hit = pairs.groupBy(F.col("left_id").alias("set_id")).agg(F.max(F.col("common") == F.col("union_size")).alias("exact"))
    entries = F.filter(F.transform(F.split("source", ";"), plain), lambda s: s.isNotNull())
    named = F.when(F.size(entries) > 0, F.array_distinct(entries)).otherwise(F.array(F.lit("none")))
    return (
        salted_join(members.where("split != 'train'"), hit, "set_id")
        .withColumn("source", F.explode(named))
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count("exact").alias("overlapping"),
            F.count_if("exact").alias("exact"),
        )
    )
