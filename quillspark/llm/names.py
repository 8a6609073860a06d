"""Variant spellings of names typed by people: persons among authors, venues.

Names are parsed into family name, given name and initials; where two plain words may stand in either
order, the roles their words take elsewhere in the corpus decide. A prefix-filtered set-similarity join on
q-grams (the q-grams of one part, joined with the other part, rarest first) finds keys that differ
in one part. A soft weighted token similarity verifies them: each token weighs by its rarity (the log of all
partners over its own), equal tokens count in full, and a token one edit away counts by its likeness times the
chance that the rarer spelling is a slip of the usual one: it is one while it occurs with no more partners than
slips of the usual word would. Initials join the person of the same family name they fit; closed groups of keys
are the entities. Venues are compared word by word: equal, one edit apart, or one an abbreviation of the other.

Every name has a confidence: the similarity that links it, and for initials the share of the person among all
that fit. Defined results: null and blank names take no part; a spelling pairs with others of its entity, never
with itself; repeated rows count once; with several fitting persons, initials go to the likeliest, the most
frequent one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.packed import ORG_WORDS, PARTICLES
from ..session import stored
from .graph import block_pairs, components
from .matching import fold, near_words
from .nicknames import FULL
from .survivors import NO_VENUE

_SUFFIX = re.compile(r",?\s+(?:Jr|Sr)\.?$|,\s*(?:JR|SR|II|III)\.?$")  # JR without a comma are initials
_INITIALS = re.compile(r"^(?:[^\W\d_]\.-?){1,4}$|^[A-Z]{1,3}$|^[^\W\d_]$")
_ORG = re.compile(r"\b(?:" + "|".join(ORG_WORDS) + r")\b")
SLIPS, SLIP_SHARE, STEEP = 3, 0.1, 4  # a slip is seen with up to so many partners or that share of the usual word's; how sharply the chance falls beyond
ALIKE = 0.5  # similarity from which two keys are one person


def parse_name(name: str) -> tuple[str, str, str, str, str]:
    """(form, family, given, initials, other): form is 'sure', 'open' (given and other may change places), 'group'.

    Family and given names come folded, without spaces and marks.
    """
    raw = _SUFFIX.sub("", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name.strip().replace("’", "'")))
    if _ORG.search(raw):
        return "group", " ".join(re.findall(r"[^\W_]+", fold(raw))), "", "", ""
    squash = lambda ws: re.sub(r"[\W_]+", "", fold("".join(ws)))
    first = lambda ws: "".join(ch for w in ws for ch in fold(w) if ch.isalpha()) if ws else ""
    if "," in raw:
        left, _, right = raw.partition(",")
        words = right.split()
        given = [w for w in words if not _INITIALS.match(w)]
        marks = [w for w in words if _INITIALS.match(w)]
        g = squash(given[:1])
        g = FULL.get(g, g)
        return "sure", squash(left.split()), g, (g[:1] if g else "") + first(marks), ""
    words = raw.split()
    units: list[tuple[str, bool]] = []  # word, carries a particle
    at = 0
    while at < len(words):
        part = []
        while at < len(words) - 1 and fold(words[at]) in PARTICLES and not (words[at].isupper() and not words[at + 1].isupper()):
            part.append(words[at])
            at += 1
        units.append(("".join(part) + words[at], bool(part)))
        at += 1
    marks = [w for w, p in units if not p and _INITIALS.match(w)]
    plain = [(w, p) for w, p in units if p or not _INITIALS.match(w)]
    if not plain:
        return "sure", squash(words), "", "", ""
    if len(plain) == 1:
        return "sure", squash([plain[0][0]]), "", first(marks), ""
    loud = [i for i, (w, p) in enumerate(plain) if p or (w.isupper() and len(w) > 3)]
    if loud and not all(w.isupper() for w, _ in plain):
        k = loud[0]
        rest = [w for i, (w, _) in enumerate(plain) if i not in loud]
        if rest:
            g = squash(rest[:1])
            g = FULL.get(g, g)
            return "sure", squash([plain[i][0] for i in loud]), g, g[:1] + first(marks), ""
    a, z = squash([plain[0][0]]), squash([w for w, _ in plain[1:]])
    if marks and _INITIALS.match(units[-1][0]):
        return "sure", squash([w for w, _ in plain]), "", first(marks), ""  # Family AB
    if marks:  # Given M. Family
        g = FULL.get(a, a)
        return "sure", z, g, g[:1] + first(marks), ""
    if len(plain) > 2:
        return "open", z, FULL.get(a, a), "", squash([w for w, _ in plain[:-1]]) + "|" + squash([plain[-1][0]])
    return "open", z, FULL.get(a, a), "", a + "|" + z


_PARSED = "name string, n long, form string, family string, given string, initials string, other string"


def parsed_names(names: DataFrame) -> DataFrame:
    """names (name, n) -> their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, n, *parse_name(name)) for name, n in zip(b["name"], b["n"])]
            yield pd.DataFrame(rows, columns=["name", "n", "form", "family", "given", "initials", "other"])

    return names.mapInPandas(run, _PARSED)


def settle_order(parsed: DataFrame) -> DataFrame:
    """Open names get the order in which their words' roles elsewhere agree more."""
    sure = parsed.where("form = 'sure'")
    roles = (
        sure.select(F.col("family").alias("word"), F.col("n").alias("as_family"), F.lit(0).alias("as_given"))
        .unionByName(sure.where("given <> ''").select(F.col("given").alias("word"), F.lit(0).alias("as_family"), F.col("n").alias("as_given")))
        .groupBy("word").agg(F.log1p(F.sum("as_family")).alias("f"), F.log1p(F.sum("as_given")).alias("g"))
    )
    turned = parsed.where("form = 'open'").withColumn("t_family", F.expr("split(other, '[|]')[0]")).withColumn("t_given", F.expr("split(other, '[|]')[1]"))
    full = F.create_map(*[F.lit(x) for kv in FULL.items() for x in kv])
    turned = turned.withColumn("t_given", F.coalesce(F.try_element_at(full, F.col("t_given")), F.col("t_given")))
    role = lambda col, p: roles.select(F.col("word").alias(col), F.col("f").alias(f"{p}f"), F.col("g").alias(f"{p}g"))
    j = turned.join(role("family", "a"), "family", "left").join(role("given", "b"), "given", "left").join(role("t_family", "c"), "t_family", "left").join(role("t_given", "d"), "t_given", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    as_is = z("af") - z("ag") + z("bg") - z("bf") + F.lit(0.5)
    swapped = z("cf") - z("cg") + z("dg") - z("df")
    swap = swapped > as_is
    settled = j.select("name", "n", F.lit("sure").alias("form"), F.when(swap, F.col("t_family")).otherwise(F.col("family")).alias("family"), F.when(swap, F.col("t_given")).otherwise(F.col("given")).alias("given"))
    return parsed.where("form <> 'open'").select("name", "n", "form", "family", "given", "initials").unionByName(settled.withColumn("initials", F.substring("given", 1, 1)))


def grams(text: Column, q: int) -> Column:
    """Distinct q-grams of the text with an edge mark on either side."""
    t = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (q - 1), F.lit(1))), lambda i: F.substring(t, i, q)))


def similar_pairs(rows: DataFrame, key: str, tokens: str, least: float | str) -> DataFrame:
    """key_a < key_b whose token sets have a Jaccard similarity of ``least`` (a number, or a column of it) or more.

    Prefix filtering: tokens in order of rising frequency; two sets that similar share one of the first
    n - ceil(least * n) + 1. Only those are joined, with a filter on the sizes; frequent tokens are joined in squares.
    """
    each = rows.select(F.col(key).alias("key"), (F.col(least) if isinstance(least, str) else F.lit(least)).alias("least"), F.explode(tokens).alias("t"))
    freq = each.groupBy("t").agg(F.count("*").alias("f"))
    ordered = each.join(freq, "t").groupBy("key", "least").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o")).select("key", "least", F.transform("o", lambda s: s["t"]).alias("set"))
    size = F.size("set")
    prefix = stored(ordered.select("key", "least", "set", size.alias("size"), F.slice("set", 1, (size - F.ceil(size * F.col("least")) + 1).cast("int")).alias("prefix")))
    probe = prefix.select("key", "least", "size", F.explode("prefix").alias("t"))
    cand = block_pairs(probe, "t", "key", ["size", "least"]).where((F.col("size_a") >= F.col("size_b") * F.col("least_a")) & (F.col("size_b") >= F.col("size_a") * F.col("least_a"))).select("key_a", "key_b", F.col("least_a").alias("least")).distinct()
    sets = lambda p: prefix.select(F.col("key").alias(f"key_{p}"), F.col("set").alias(f"set_{p}"))
    both = cand.join(sets("a"), "key_a").join(sets("b"), "key_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= F.col("least") * (F.size("set_a") + F.size("set_b") - shared)).select("key_a", "key_b")


def _kind(rows: DataFrame, kind: str, text: str, other: str, q: int, least: float) -> DataFrame:
    """Rows of one similarity join among several done at once: keys and tokens carry its two letters."""
    return rows.select(F.concat(F.lit(f"{kind}|"), "key").alias("key"), F.transform(grams(F.col(text), q), lambda g: F.concat_ws("|", F.lit(kind), other, g)).alias("t"), F.lit(least).alias("least"))


def _joined(kinds: list[DataFrame]) -> DataFrame:
    """key_a < key_b of all joins, without the letters."""
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    plain = lambda c: F.substring(c, F.lit(4), F.length(c)).alias(c)
    return similar_pairs(rows, "key", "t", "least").select(plain("key_a"), plain("key_b")).distinct()


def _family_kinds(rows: DataFrame, other: str) -> list[DataFrame]:
    return [_kind(rows, "f2", "family", other, 2, 0.3), _kind(rows.where(F.length("family") <= 5), "f1", "family", other, 1, 0.6)]


def near_families(rows: DataFrame, other: str) -> DataFrame:
    """key_a < key_b of equal ``other`` whose family names may be one slip apart: every pair ``_near`` accepts is among them.

    In up to four letters a swap leaves too few 2-grams; single letters keep a Jaccard of 0.6 at any one edit.
    """
    return _joined(_family_kinds(rows, other))


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near_words(x, y, 1) or (min(len(x), len(y)) in (2, 3) and x[:1] == y[:1] and near_words(x + "....", y + "....")) or (len(x) == len(y) == 4 and sorted(x) == sorted(y) and x[0] == y[0]) for x, y in zip(a, b)])


def soft_similarity(equal_usage: Column, usage_a: Column, usage_b: Column, likeness: Column, all_equal: Column, all_other: Column) -> Column:
    """Of two keys with one equal token and one that differs.

    The usages are the tokens' numbers of partners, ``all_*`` those of all tokens of that kind.
    """
    rarity = lambda usage, of: F.log(1 + of / usage)
    less, more = F.least(usage_a, usage_b), F.greatest(usage_a, usage_b)
    slip = 1 / (1 + F.pow(less / F.greatest(F.lit(float(SLIPS)), more * SLIP_SHARE), STEEP))
    same, other = rarity(equal_usage, all_equal), rarity(less, all_other)
    return (same + other * likeness * slip) / (same + other)


def person_keys(settled: DataFrame) -> DataFrame:
    """key, family, given, n, entity (the least key), confidence (of the key in its entity)."""
    keys = stored(settled.where("form = 'sure' and given <> '' and family <> ''").groupBy("family", "given").agg(F.sum("n").alias("n")).withColumn("key", F.concat_ws("|", "family", "given")))
    with_family = keys.groupBy("family").agg(F.count("*").alias("givens"))
    with_given = keys.groupBy("given").agg(F.count("*").alias("families"))
    wide = stored(keys.join(with_family, "family").join(with_given, "given").select("key", "family", "given", "givens", "families", "n"))
    all_families, all_givens = (F.lit(float(x)) for x in wide.agg(F.countDistinct("family"), F.countDistinct("given")).first())
    near = stored(_joined([*_family_kinds(keys, "given"), _kind(keys, "g1", "given", "family", 1, 0.6)]))
    side = lambda p: wide.select(F.col("key").alias(f"key_{p}"), *[F.col(c).alias(f"{c}_{p}") for c in ("family", "given", "givens", "families", "n")])
    pairs = near.join(side("a"), "key_a").join(side("b"), "key_b")
    likeness = lambda c: 1 - 1 / F.greatest(F.length(f"{c}_a"), F.length(f"{c}_b"))
    family_slip = (F.col("given_a") == F.col("given_b")) & _near("family_a", "family_b")
    given_slip = (F.col("family_a") == F.col("family_b")) & _near("given_a", "given_b")
    similarity = F.when(family_slip, soft_similarity(F.col("families_a"), F.col("givens_a"), F.col("givens_b"), likeness("family"), all_families, all_givens)).when(given_slip, soft_similarity(F.col("givens_a"), F.col("families_a"), F.col("families_b"), likeness("given"), all_givens, all_families))
    links = stored(pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), similarity.alias("s")).where(F.col("s") >= ALIKE))
    comp = components(links)
    ends = links.select(F.col("a").alias("key"), "s").unionByName(links.select(F.col("b").alias("key"), "s")).groupBy("key").agg(F.max("s").alias("s"))
    return wide.join(comp.withColumnRenamed("id", "key"), "key", "left").join(ends, "key", "left").select("key", "family", "given", "n", F.coalesce("comp", "key").alias("entity"), F.coalesce("s", F.lit(1.0)).alias("confidence"))


def person_entities(names: DataFrame) -> DataFrame:
    """names (name, n) -> name, entity, confidence."""
    settled = stored(settle_order(stored(parsed_names(names))))
    keys = stored(person_keys(settled))
    full = settled.where("form = 'sure' and given <> ''").join(keys.select("family", "given", "entity", "confidence"), ["family", "given"]).select("name", "entity", "confidence")
    # Initials: the entity of that family name whose given name starts so; middle initials must agree where both are known.
    middles = settled.where("form = 'sure' and given <> '' and length(initials) > 1").join(keys.select("family", "given", "entity"), ["family", "given"]).groupBy("entity").agg(F.collect_set(F.substring("initials", 2, 1)).alias("middles"))
    weight = keys.groupBy("entity").agg(F.sum("n").alias("weight"))
    homes = keys.select("entity", "family", F.substring("given", 1, 1).alias("initial")).distinct().join(weight, "entity").join(middles, "entity", "left")
    short = settled.where("form = 'sure' and given = '' and family <> ''").select("name", "family", F.substring("initials", 1, 1).alias("initial"), F.substring("initials", 2, 1).alias("middle"))
    fits = short.join(homes, ["family", "initial"]).withColumn("agree", F.when((F.col("middle") == "") | F.col("middles").isNull(), 0).when(F.array_contains("middles", F.col("middle")), 1).otherwise(-1))
    # The most frequent person is the likeliest; the confidence is this person's share among those that fit as well.
    share = fits.groupBy("name", "agree").agg(F.max_by("entity", F.struct(F.col("weight"), F.col("entity"))).alias("entity"), (F.max("weight") / F.sum("weight")).alias("confidence"))
    best = share.groupBy("name").agg(F.max_by(F.struct("entity", "confidence"), F.col("agree")).alias("b")).select("name", "b.entity", "b.confidence")
    # No such person: a family name one slip away, with the same initial.
    lone = stored(short.join(best, "name", "left_anti").select("name", "family", "initial"))
    probe = lone.select(F.concat_ws("|", F.lit("~"), "family", "initial").alias("key"), "family", "initial").distinct().unionByName(homes.select(F.concat_ws("|", "entity", "family", "initial").alias("key"), "family", "initial"))
    near = near_families(probe, "initial")
    near = near.select(F.col("key_a").alias("k"), F.col("key_b").alias("o")).unionByName(near.select(F.col("key_b").alias("k"), F.col("key_a").alias("o"))).where("k like '~|%' and o not like '~|%'")
    part = lambda c, i: F.element_at(F.split(F.col(c), "[|]"), i)
    slips = near.where(_near(part("k", 2), part("o", -2))).select(part("k", 2).alias("family"), part("k", 3).alias("initial"), F.concat_ws("|", part("o", 1), part("o", 2)).alias("entity")).join(weight, "entity")
    slip = slips.withColumn("r", F.row_number().over(Window.partitionBy("family", "initial").orderBy(F.col("weight").desc(), "entity"))).where("r = 1").select("family", "initial", "entity")
    slip = slip.withColumn("confidence", F.lit(ALIKE))
    alone = lone.join(slip, ["family", "initial"], "left").select("name", F.coalesce("entity", F.concat_ws("|", "family", F.concat(F.lit("~"), "initial"))).alias("entity"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    groups = settled.where("form = 'group'").select("name", F.concat(F.lit("group|"), "family").alias("entity"), F.lit(1.0).alias("confidence"))
    return full.unionByName(best).unionByName(alone).unionByName(groups)


# ---- venues ----
_SMALL = {"of", "on", "in", "and", "the", "for", "to", "a", "an", "de", "et", "with"}


def _slipped_small(w: str) -> bool:
    """A small word misspelled: a letter doubled, swapped, lost or changed. Digits and the J of journals stay."""
    if w.isdigit() or w == "j" or len(w) > 4:
        return False
    if len(w) <= 2:
        return True
    doubled = any(w[k] == w[k - 1] and w[:k] + w[k + 1 :] in _SMALL for k in range(1, len(w)))
    swapped = any(len(s) == len(w) and sorted(s) == sorted(w) for s in _SMALL)
    changed = len(w) == 3 and any(sum(a != b for a, b in zip(w, s)) == 1 for s in ("the", "and", "for"))
    return doubled or swapped or changed


def venue_words(venue: str) -> tuple[list[str], bool]:
    """(content words in their usual order, is one word of capitals)."""
    t = venue.strip()
    m = re.match(r"^(.*),\s*((?:\w+\s+){0,4}(?:of|on|in|for))\s*$", t, re.I)
    if m:
        t = f"{m[2]} {m[1]}"
    words = [w for w in re.findall(r"[^\W_]+", fold(t.replace("&", " and "))) if w not in _SMALL]
    if len(words) > 2:
        words = [w for i, w in enumerate(words) if not (i and _slipped_small(w))]
    short = bool(re.fullmatch(r"[A-Z]{3,10}", venue.strip())) and len(words) == 1
    if len(words) > 3 and ("proceedings".startswith(words[0]) and len(words[0]) > 2 or near_words(words[0], "proceedings")):
        words = words[1:]  # the series and its proceedings are one
    return words, short


def abbreviates(a: str, b: str) -> bool:
    """Equal, one edit apart, or one the abbreviation of the other (its start, or its letters in order)."""
    if a == b or (min(len(a), len(b)) >= 5 and near_words(a, b)):
        return True
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    if not s or s[0] != l[0] or len(s) == len(l):
        return False
    if l.startswith(s):
        return True
    if len(s) >= 4 and any(near_words(s, l[:n]) for n in (len(s) - 1, len(s), len(s) + 1)) and len(l) - len(s) >= 3:
        return True
    if len(s) > 5:
        return False
    it = iter(l)
    return len(s) >= 3 and all(ch in it for ch in s)


def venue_entities(venues: DataFrame) -> DataFrame:
    """venues (name, n) -> name, entity, confidence (of capitals: the venue's share among those with these initials)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, n in zip(b["name"], b["n"]):
                words, short = venue_words(name)
                if words:
                    out.append((name, n, " ".join(words), "".join(w[0] for w in words) if not short else words[0], short))
            if out:  # a frame without rows has no types
                yield pd.DataFrame(out, columns=["name", "n", "words", "initials", "short"])

    rows = stored(venues.where(~F.col("name").rlike(NO_VENUE)).mapInPandas(run, "name string, n long, words string, initials string, short boolean"))
    keys = rows.where("not short").groupBy("words", "initials").agg(F.sum("n").alias("n"))
    by_initials = block_pairs(keys, "initials", "words")
    by_grams = similar_pairs(keys.select(F.col("words").alias("key"), grams(F.col("words"), 3).alias("t")), "key", "t", 0.7)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = x.split(), y.split()
            out.append(len(p) == len(q) and all(abbreviates(v, w) for v, w in zip(p, q)) and sum(v != w and len(v) == len(w) or (v != w and not v.startswith(w) and not w.startswith(v) and abs(len(v) - len(w)) < 3) for v, w in zip(p, q)) <= 2)
        return pd.Series(out)

    links = by_initials.unionByName(by_grams).distinct().where(same("key_a", "key_b")).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    comp = components(links)
    entity = stored(keys.join(comp.withColumnRenamed("id", "words"), "words", "left").select("words", "initials", "n", F.coalesce("comp", "words").alias("entity")))
    long = rows.where("not short").join(entity.select("words", "entity"), "words").select("name", "entity", F.lit(1.0).alias("confidence"))
    # A word of capitals joins the venue with these initials, the most frequent one if there are several.
    homes = entity.groupBy("initials", "entity").agg(F.sum("n").alias("n"))
    best = homes.groupBy("initials").agg(F.max_by("entity", F.struct(F.col("n"), F.col("entity"))).alias("entity"), (F.max("n") / F.sum("n")).alias("share"))
    caps = rows.where("short").join(best, "initials", "left")
    proc = best.select(F.concat(F.lit("p"), "initials").alias("initials"), F.col("entity").alias("p_entity"), F.col("share").alias("p_share"))
    short = caps.join(proc, "initials", "left").select("name", F.coalesce("entity", "p_entity", "words").alias("entity"), F.coalesce("share", "p_share", F.lit(1.0)).alias("confidence"))
    return long.unionByName(short)


def spelling_pairs(entities: DataFrame, kind: str) -> DataFrame:
    """kind, name_a < name_b of one entity."""
    e = stored(entities.select("name", "entity").distinct())
    x, y = e.alias("x"), e.alias("y")
    return x.join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("x.name") < F.col("y.name"))).select(F.lit(kind).alias("kind"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
