import random

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillspark.llm import graph, matching, names, queries, survivors, vectors  # noqa: E402


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + 3 * i, 100 + 3 * i + 1) for i in range(20)] + [(500, 500)]
    rng.shuffle(edges)
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + 3 * i + 1] == 100 + 3 * i for i in range(20)) and 500 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("title,marker", [("Ice on Mars and more", ""), ("Ice on Mars and more, part II", "part2"), ("Ice on Mars and more III", "part3"), ("Correction to: Ice on Mars and more", "correction"), ("Correcction to Ice on Mars and more", "correction"), ("Reply to: Ice on Mars and more", "reply"), ("Ice on Mars and more: a sequel", "sequel"), ("Notes on Ice on Mars and more", "notes")])
def test_markers(title, marker):
    core, m = matching.title_parts(f"<i>{title}</i>")
    assert m == marker and core == "ice on mars and more"


def test_title_features():
    f = matching.title_features
    assert f("a b", "a b") == (1.0, 0.0, 0.0)
    assert f("hybrid approach to magnetic flow", "hybrd approach to magnetic flow")[1] == 0
    assert f("models after 9 years of ice", "models after 7 years of ice")[1] == 1
    assert f("causal supply chain", "coastal supply chain", {"causal", "coastal"})[1] == 1
    assert f("", "")[0] == 0.0


def rows():
    base = [("Neural ozone layer for speech act in science", "Ann Smith; Bo Larsson", "2019", "10.1234/ab.1"), ("Arid membrane under epidemic kelp bed", "Carla Diaz", "2015", "10.1234/ab.2"), ("Re-examining low cost argument graph after 9 years", "Dan Evans; Eva Frank", "2020", "10.1234/ab.3")]
    out = []
    for k, (t, a, y, doi) in enumerate(base):
        out += [(f"w{k}:0", t, a, y, doi), (f"w{k}:1", t.upper(), a.replace("; ", " and "), y, None), (f"w{k}:2", t.replace("l", "ll", 1), a, None, f"DOI {doi.upper()}.")]
    out += [("w0p:0", base[0][0] + ", part II", base[0][1], "2021", None), ("w2q:0", base[2][0].replace("9", "7"), "Gil Hart", "2001", None), ("w1s:0", base[1][0], "Ivo Jones; Kim Long", "1999", None), ("x:0", None, None, None, None), ("y:0", "", "", "", "")]
    return out


def test_works(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows() * 2], "nid string, title string, authors string, date string, doi string, work string")
    nodes, scored, _, _ = matching.works(df)
    by = {}
    for r in nodes.collect():
        by.setdefault(r.work, set()).add(r.nid)
    groups = {frozenset(v) for v in by.values()}
    assert {frozenset({f"w{k}:{i}" for i in range(3)}) for k in range(3)} <= groups
    assert frozenset({"w0p:0"}) in groups and frozenset({"w2q:0"}) in groups and frozenset({"w1s:0"}) in groups
    assert all(0 <= r.confidence <= 1 for r in scored.collect())


def test_works_of_an_empty_table(spark):
    nodes, scored, _, _ = matching.works(spark.createDataFrame([], "nid string, title string, authors string, date string, doi string"))
    assert nodes.count() == 0 and scored.count() == 0


def test_wide_blocks_lose_no_link(spark):
    """One title held by many different author groups: more signatures than a block compares in full."""
    data = []
    for k in range(70):
        a = f"{chr(65 + k % 26)}lbert Xu{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3}{'bcdfghjklm'[k // 26] * 3}"
        data += [(f"g{k}:0", "An introduction to the field of study", a, "2000", None), (f"g{k}:1", "An introduction to the field of study.", a, "2001", f"10.1234/z.{k}")]
    nodes = matching.works(spark.createDataFrame(data, "nid string, title string, authors string, date string, doi string"))[0]
    work = {r.nid: r.work for r in nodes.collect()}
    assert sum(work[f"g{k}:0"] == work[f"g{k}:1"] for k in range(70)) == 70


@pytest.mark.parametrize("n", [48, 49, 150])
def test_blocks_of_any_size_give_all_pairs(spark, n):
    """Different titles that meet only by author pair and year, with two markers."""
    rng = random.Random(5)
    reps = [(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)), "part2" if k % 10 == 0 else "", "", 2001, "smith ann;larsson bo") for k in range(n)]
    df = spark.createDataFrame(reps, "rep long, core string, marker string, doi string, year int, names string")
    got = [(r.a, r.b) for r in matching.candidate_pairs(df).collect()]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (a % 10 == 0) == (b % 10 == 0)}
    assert len(got) == len(set(got)) and want <= set(got)


def test_what_is_kept_follows_the_rows(spark, monkeypatch):
    """A title of many works: pairs grow with the square of the rows, what is stored of them does not; parts lose no link."""
    data = []
    for k in range(70):
        a = f"{chr(65 + k % 26)}lbert Xu{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3}{'bcdfghjklm'[k // 26] * 3}"
        data += [(f"g{k}:0", "An introduction to the field of study", a, "2000", None), (f"g{k}:1", "An introduction to the field of study.", a, "2001", f"10.1234/z.{k}")]
    for name, value in (("FIT_REPS", 20), ("PART_REPS", 70), ("MEETINGS", 600), ("FEW", 1)):
        monkeypatch.setattr(matching, name, value, raising=False)
    kept, write = [], matching.stored

    def stored(df, *by):
        out = write(df, *by)
        if "a" in df.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(matching, "stored", stored)
    nodes = matching.works(spark.createDataFrame(data, "nid string, title string, authors string, date string, doi string"))[0]
    work = {r.nid: r.work for r in nodes.collect()}
    assert sum(work[f"g{k}:0"] == work[f"g{k}:1"] for k in range(70)) == 70
    assert max(kept) <= 5 * len(data) and len(kept) >= 3, kept


def test_a_hot_block_sends_numbers_not_pairs(spark, monkeypatch):
    """Signatures in several chunks: all pairs meet, in parts too, and what is sent of a block follows its size, not its square."""
    monkeypatch.setattr(matching, "CHUNK_REPS", (50, 60))
    monkeypatch.setattr(matching, "AT_ONCE", 500)
    n = 300
    reps = [(k * 7919 - 10**6, f"title {k}", "", "10.1234/one", 0, "") for k in range(n)]
    df = spark.createDataFrame(reps, "rep long, core string, marker string, doi string, year int, names string")
    chunks = matching.Chunks.of(df, n)
    lists = matching.block_lists(chunks, n)
    assert chunks.n == 5 or chunks.n == 6
    hot = max(len(r.ids) // 4 for r in lists.collect())
    assert hot >= n
    got = [(r.a, r.b) for r in matching.candidate_pairs(df).collect()]
    keys = [r[0] for r in reps]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]}
    blocks = sum(len(r.ids) // 4 for r in lists.collect())
    sent = lambda *p: sum(len(r.left) + len(r.right) for r in matching.cells(lists, chunks.n, *p).collect()) // 4
    assert sent() <= 2 * chunks.n * blocks < n * (n - 1) / 2 * 4
    found = lambda x, y, a, b: iter([matching.pa.RecordBatch.from_arrays([matching.pa.array([len(a)])], ["n"])])
    count = lambda *p: sum(r.n for r in matching.meet(chunks, matching.cells(lists, chunks.n, *p), ["rep"], found, "n long").collect())
    assert count(0, 3) + count(1, 3) + count(2, 3) == n * (n - 1) // 2


def test_authors_are_alike_with_and_without_the_glance_at_their_forms():
    rng = random.Random(3)
    words = ["smith", "smiht", "smyth", "li", "bo", "larsson", "larson", "alexandrina", "alexadrna", "ann", "anne", "vanburen", "van", "buren"]
    people = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) for _ in range(150)] + ["J smith", "A"]
    for a in people:
        for b in people:
            p, q = matching._person(a), matching._person(b)
            assert matching._same_author(p, q) == matching._same_words(p[0], q[0]), (a, b)


def test_papers_that_meet_through_a_record_are_one_group(spark, tmp_path):
    papers = [("a", "Neural ozone layer for speech act in science", "Ann Smith; Bo Larsson", 2019, None), ("b", None, "Ann Smith; Bo Larsson", 2019, "10.1234/ab.1"), ("c", "Arid membrane under epidemic kelp bed", "Carla Diaz", 2015, None)]
    records = [("r", "Neural ozone layer for speech act in science", "Ann Smith; Bo Larsson", "2019-05-01", "10.1234/ab.1"), ("s", "Arid membrane under epidemic kelp bed", "Carla Diaz", "2015", None)]
    spark.createDataFrame(papers, "id string, title string, authors string, year int, doi string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame(records, "id string, title string, authors_raw string, published_date string, doi string").write.parquet(str(tmp_path / "provider_records.parquet"))
    assert {(r.id, r.group_id) for r in queries._groups(spark, str(tmp_path)).collect()} == {("a", "a"), ("b", "a")}


def test_chance_of_meeting_in_a_band():
    """By the LSH formula: 1 - (1 - j^4)^8 per author token, 1 - (1 - j^8)^16 for titles alone."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    grams = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}
    met, due = np.zeros(2), np.zeros(2)
    for _ in range(4000):
        a = "".join(rng.choice(letters) for _ in range(60))
        b = "".join(rng.choice(letters) if rng.random() < 0.07 else c for c in a)
        j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        met += [bool(set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())) for at, keys in reversed(matching.band_keys([a, b], ["smith", "smith"]))]
        due += [1 - (1 - j**4) ** 8, 1 - (1 - j**8) ** 16]
    assert (met >= 0.95 * due).all(), (met, due)


def test_bands_do_not_depend_on_the_batch():
    cores = ["a b c", "", "ice", "kelp bed under ice", "x", "naïve 日本 語", "a b c"]
    names = ["smith ann;diaz", "", "", "o", "smith", "x", "other"]
    together = matching.band_keys(cores, names)
    for i, (c, n) in enumerate(zip(cores, names)):
        for (_, alone), (at, keys) in zip(matching.band_keys([c], [n]), together):
            assert alone.tolist() == keys[at == i].tolist()
    at, keys = together[0]
    assert keys[at == 0].tolist() == keys[at == 6].tolist() and not (at == 1).any()


def test_trigrams_of_a_word_are_hashed_once(monkeypatch):
    """Titles made of the same words cost their distinct words, and get the values of all their trigrams."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20)]
    cores = [" ".join(rng.choice(words) for _ in range(10)) for _ in range(400)] + ["x", "日本 語", " a  b ", " "]
    hashed, mix = [], matching._mix
    monkeypatch.setattr(matching, "_mix", lambda x: (hashed.append(len(x)), mix(x))[1])
    got = matching._minima(cores)
    assert sum(hashed) < sum(map(len, cores)) / 10, hashed
    for c, low in list(zip(cores, got))[::40] + list(zip(cores, got))[-4:]:
        t = np.array([ord(ch) for ch in f" {c} "], np.uint64)
        grams = mix(t[:-2] * matching._WEIGHTS[0] + t[1:-1] * matching._WEIGHTS[1] + t[2:] * matching._WEIGHTS[2])
        assert (low == (grams[:, None] * matching._SEEDS[0] + matching._SEEDS[1]).min(0)).all(), c


def test_authors_of_pairs_that_cannot_link_are_not_compared(spark, monkeypatch, tmp_path):
    """Titles that share half of their words, by the same two authors in one year, are of two works whoever wrote them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    data = [(f"h{k}", f"arid membrane under kelp {word()} {word()} {word()}", f"Smith Ann; Larsson Bo; {word().title()} Carla", "2001", None) for k in range(40)]
    data += [(f"{r[0]}:1", r[1] + ".", r[2], "2002", None) for r in data[:5]]
    asked, compare = str(tmp_path / "asked"), matching.author_similarity

    def counted(a, b):
        with open(asked, "a") as f:
            f.write("1")
        return compare(a, b)

    monkeypatch.setattr(matching, "author_similarity", counted)
    nodes, linked, _, _ = matching.works(spark.createDataFrame(data, "nid string, title string, authors string, date string, doi string"))
    work = {r.nid: r.work for r in nodes.collect()}
    assert [k for k in range(5) if work[f"h{k}"] == work[f"h{k}:1"]] == [0, 1, 2, 3, 4] and len(set(work.values())) == 40
    with open(asked) as f:
        assert 5 <= len(f.read()) < 40 * 39 / 2 / 10


def test_only_pairs_that_cannot_link_are_left_out():
    """Whatever the authors' agreement, a pair with a confidence of one half is kept."""
    rng = np.random.default_rng(4)
    n = 20_000
    ts, both, y = rng.uniform(matching.ALIKE, 1, n), rng.random(n) < 0.8, rng.integers(0, 4, n)
    sub, told, au = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.choice([0.0, -0.1, 0.339, 0.34, 0.5, 0.799, 0.8, 1.0], n) * both
    f = {"ts": ts, "poor": ts < 0.7, "sub1": sub == 1, "sub2": sub == 2, "drop": rng.uniform(0, 3, n), "am": ~both, "y0": y == 0, "y1": y == 1, "y2": y == 2, "de": told == 1, "dd": told == 2, "tm": np.zeros(n, bool)}
    full = f | {"au": au, "ad": both & (au < 0.34), "aum": both & (au >= 0.34) & (au < 0.8), "ta": ts * au}
    left_out = 0
    for weights, q, r in [(matching.PRIOR, 0.9, 0.005), *((rng.normal(size=14) * 2, 0.5 + rng.random() / 2, rng.random() / 2) for _ in range(20))]:
        w = np.array(weights)
        z = w[-1] + sum(v * full[k] for k, v in zip(matching.FEATURES, w))
        text = np.clip((1 / (1 + np.exp(-z)) - r) / (q - r), 1e-4, 1 - 1e-3)
        links = np.log(text / (1 - text)) + np.where(f["de"], np.log(q / r), np.where(f["dd"], np.log((1 - q) / (1 - r)), 0.0)) >= 0
        may = matching.Evidence(w, q, r, []).may_link(f)
        assert not (links & ~may).any()
        left_out += (~may).sum()
    assert left_out > n


def slow_title_features(a, b, common):
    """The word comparison without its cheap tests."""
    x, y = a.split(), b.split()
    left, rest = list(y), []
    for w in x:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    lone = 0
    for w in rest:
        near = [v for v in left if not (w in common and v in common)]
        hit = next((v for v in near if matching.near_words(w, v)), None)
        if hit is None and not w.isdigit():
            close = [(matching._distance(w, v) / max(len(w), len(v)), v) for v in near if not v.isdigit() and abs(len(w) - len(v)) <= 3]
            hit = min(close)[1] if close and min(close)[0] <= matching.LOOSELY else None
        if hit is None:
            lone += 1
        else:
            left.remove(hit)
    return 1 - (lone + len(left)) / (len(x) + len(y))


def test_cheap_tests_of_titles_change_nothing():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeo5") for _ in range(rng.randrange(2, 10)))
    for _ in range(1500):
        pool = [word() for _ in range(6)]
        a, b = (" ".join(rng.choice(pool)[: rng.randrange(2, 10)] + rng.choice(["", "a", "d"]) for _ in range(rng.randrange(2, 7))) for _ in range(2))
        common = set(rng.sample(pool, 2))
        got = matching.title_features(a, b, common)
        if got[1] < 3 and a != b and "".join(sorted(a.replace(" ", ""))) != "".join(sorted(b.replace(" ", ""))):
            assert abs(got[0] - slow_title_features(a, b, common)) < 1e-9, (a, b, common)


def test_the_cheap_test_of_words_is_necessary():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        d = matching._distance(a, b) / max(len(a), len(b))
        assert matching._unlike(a, b) == (d if d <= matching.LOOSELY else 1.0)


def pairs_with_identifiers(n, seed, wrong=0.1):
    """Feature rows of pairs of which the truth is known; identifiers agree by it but for errors."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        same = rng.random() < 0.6
        ts = float(np.clip(rng.normal(0.95 if same else 0.65, 0.1), 0.4, 1))
        au = float(np.clip(rng.normal(0.9 if same else 0.35, 0.25), 0, 1))
        de = float(rng.random() < (1 - wrong if same else 0.01))
        row = dict.fromkeys(matching.FEATURES, 0.0) | {"ts": ts, "au": au, "ta": ts * au, "poor": float(ts < 0.7), "ad": float(au < 0.34), "aum": float(0.34 <= au < 0.8), "y0": 1.0}
        out.append(row | {"a": k, "b": k * 7 + 1, "de": de, "dd": 1 - de, "tm": 0.0, "same": same})
    return pd.DataFrame(out)


def test_confidences_are_calibrated(spark):
    known = matching.Evidence.fit(pairs_with_identifiers(6000, 1))
    assert abs(known.agree_same - 0.9) < 0.03 and known.agree_other < 0.05
    assert sum(n * abs(p - y) for _, n, p, y in known.reliability) / 6000 < 0.06  # the expected calibration error
    held = pairs_with_identifiers(6000, 2)
    got = spark.createDataFrame(held).withColumn("confidence", known.confidence(F.col)).toPandas()
    assert ((got.confidence >= 0.5) == got.same).mean() > 0.95
    gaps = [(len(g), abs(g.confidence.mean() - g.same.mean())) for _, g in got.groupby((got.confidence * 5).round())]
    assert sum(n * x for n, x in gaps) / len(got) < 0.06


def test_without_labels_the_prior_speaks(spark):
    known = matching.Evidence.fit(pairs_with_identifiers(1, 1).iloc[:0])
    assert np.abs(known.weights - matching.PRIOR).max() < 1 and known.reliability == []
    equal = spark.createDataFrame([("ice bed", "", 2001, "smith ann"), ("ice bed", "10.1/x", 2001, "smith ann"), ("", "10.1/x", 0, "")], "core string, doi string, year int, names string").select(known.of_equals().alias("c")).collect()
    assert 0.5 < equal[0].c < equal[1].c <= 1 and equal[2].c < 0.5


def test_calibration_on_held_out_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    w = matching.fit_logistic(x[:2000], y[:2000])
    q = 1 / (1 + np.exp(-(np.c_[x[2000:], np.ones(2000)] @ w)))
    for lo in (0.0, 0.25, 0.5, 0.75):
        k = (q >= lo) & (q < lo + 0.25)
        assert abs(q[k].mean() - y[2000:][k].mean()) < 0.07


def test_survivors(spark):
    ts = "timestamp_ntz'2024-01-0{}'"
    papers = spark.createDataFrame(
        [("a", "A long whole abstract of this work.", "Journal of Polar Research", None, 1), ("b", "A long who", "J. Polar Res.", " Full-Text ", 2), ("c", None, "Journal of Polar Reseaarch", "queued", 3), ("d", "x.", None, "full-text", 4), ("e", "x.", "Journal of Polar Research", "failed", 5), ("f", None, None, None, 6)],
        "id string, abstract string, venue string, evidence_state string, n int",
    ).withColumn("created_at", F.expr("timestampadd(DAY, n, timestamp_ntz'2024-01-01')"))
    groups = spark.createDataFrame([(i, "a") for i in "abc"] + [("f", "f")], "id string, group_id string")
    inputs = spark.createDataFrame([("i1", "a", 5, 1), ("i2", "b", 7, 3), ("i3", "c", 0, 9), ("i2", "b", 7, 3), ("i4", "z", 5, 9)], "input_id string, id string, citation_count int, n int").withColumn("submitted_at", F.expr("timestampadd(DAY, n, timestamp_ntz'2024-01-01')")).withColumn("received_at", F.col("submitted_at"))
    judged = spark.createDataFrame([("papers", "a", False), ("papers", "b", True)], "tbl string, record_key string, is_cut boolean")
    got = {(r.group_id, r.field_name, r.record_key) for r in survivors.best_rows(groups, papers, inputs, judged).collect()}
    assert got == {("a", "abstract", "a"), ("a", "venue", "a"), ("a", "evidence_state", "b"), ("a", "citation_count", "i2")}


def test_short_words_and_trust_are_learned(spark):
    """A short word of a venue is a word if titles use it; of equally complete rows that of the more trusted source stays."""
    titles = ["Open data on ice", "The open sea", "Open beds"]
    papers = spark.createDataFrame([(f"t{k}", t, "x", None, None, k) for k, t in enumerate(titles)] + [("a", "T", "It is whole here.", "Annals of Open Ecology", None, 9), ("b", "T", "It is whole too..", "Annals of Phys Ecology", None, 8)], "id string, title string, abstract string, venue string, evidence_state string, n int").withColumn("created_at", F.expr("timestampadd(DAY, n, timestamp_ntz'2024-01-01')"))
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, group_id string")
    inputs = spark.createDataFrame([], "input_id string, id string, citation_count int, submitted_at timestamp, received_at timestamp")
    judged = spark.createDataFrame([("papers", "a", False, "s"), ("papers", "t0", True, "s"), ("papers", "b", False, "good"), ("papers", "t1", False, "good")], "tbl string, record_key string, is_cut boolean, source string")
    got = {(r.field_name, r.record_key) for r in survivors.best_rows(groups, papers, inputs, judged).collect()}
    assert got == {("venue", "a"), ("abstract", "b")}


@pytest.mark.parametrize("name,want", [("Smith, Ann B.", ("smith", "ann")), ("Ann B. Smith", ("smith", "ann")), ("Smith AB", ("smith", "")), ("A. Smith", ("smith", "")), ("Ann VON ESK", ("vonesk", "ann")), ("Ann vonEsk", ("vonesk", "ann")), ("AF Braakley", ("braakley", "")), ("Smith, Liz", ("smith", "elizabeth")), ("Ann Smith, Jr.", ("smith", "ann"))])
def test_parse_name(name, want):
    assert names.parse_name(name)[1:3] == want


def test_set_similarity_equals_brute_force(spark):
    rng = random.Random(6)
    sets = {f"k{i}": {rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))} for i in range(120)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "key string, t array<string>")
    for least in (0.4, 0.6, 0.8):
        got = {(r.key_a, r.key_b) for r in names.similar_pairs(df, "key", "t", least).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}


def test_person_and_venue_entities(spark):
    people = [("Nathaniel Norursen", 9), ("Norursen, Nathaniel", 8), ("N. Norursen", 5), ("Norursen NS", 3), ("Nate S. Norursen", 2), ("Nathaniel Norursn", 1), ("Ilse Norursen", 4), ("Norursen, I.", 1), ("Norursen Nathaniel", 2), ("Bo Larsson", 3), ("Verrin Open Index Team", 2)]
    e = {r.name: r.entity for r in names.person_entities(spark.createDataFrame(people, "name string, n long")).collect()}
    assert len({e[n] for n in ("Nathaniel Norursen", "Norursen, Nathaniel", "N. Norursen", "Norursen NS", "Nate S. Norursen", "Nathaniel Norursn", "Norursen Nathaniel")}) == 1
    assert e["Ilse Norursen"] == e["Norursen, I."] != e["N. Norursen"] and e["Bo Larsson"] not in (e["Ilse Norursen"], e["N. Norursen"])
    venues = [("Journal of Polar Glaciology Research", 9), ("J. Polar Glaciol. Res.", 3), ("JPGR", 2), ("Polar Glaciology Research, Journal of", 1), ("journal of polar glaciology research", 1), ("Journal of Polar Glaciiology Research", 1), ("Journal of Urban Geology", 5), ("Unknown", 3), (" ", 1)]
    v = {r.name: r.entity for r in names.venue_entities(spark.createDataFrame(venues, "name string, n long")).collect()}
    assert len({v[n] for n, _ in venues[:6]}) == 1 and v["Journal of Urban Geology"] != v["JPGR"] and "Unknown" not in v
    pairs = names.spelling_pairs(spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "1"), ("z", "2")], "name string, entity string"), "author").collect()
    assert [(r.name_a, r.name_b) for r in pairs] == [("x", "y")]


def test_slips_in_short_family_names(spark):
    """Every pair that the verifier accepts is a candidate, and links its spellings."""
    forms = ["wang", "wnag", "chen", "hcen", "kim", "kmi", "li", "lu", "lee", "leee", "aaaa", "aaab", "park", "pakr", "singh", "snigh"]
    df = spark.createDataFrame([(f, f, "ann") for f in forms], "key string, family string, given string")
    got = {(r.key_a, r.key_b) for r in names.near_families(df, "given").collect()}
    both = spark.createDataFrame([(a, b) for a in forms for b in forms if a < b], "a string, b string")
    want = {(r.a, r.b) for r in both.where(names._near("a", "b")).collect()}
    assert ("wang", "wnag") in want and ("kim", "kmi") in want and want <= got
    e = {r.name: r.entity for r in names.person_entities(spark.createDataFrame([("Wang, Nathaniel", 9), ("Wnag, Nathaniel", 1), ("Kim, Ilse", 9), ("Kmi, Ilse", 1), ("Kmi, Q.", 1)], "name string, n long")).collect()}
    assert e["Wang, Nathaniel"] == e["Wnag, Nathaniel"] and e["Kim, Ilse"] == e["Kmi, Ilse"]


def test_entities_of_empty_tables(spark):
    empty = spark.createDataFrame([], "name string, n long")
    assert names.person_entities(empty).count() == 0 and names.venue_entities(empty).count() == 0


def brute_neighbours(v, k):
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -9)
    return [set(np.argsort(-r, kind="stable")[:k]) for r in s]


def test_nearest_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    v = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 32))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", x.tolist()) for i, x in enumerate(v)] + [("a", None), ("b", []), ("c", [0.0] * 32), ("d", [1.0] * 8), ("e", [float("nan")] * 32), ("00001", v[1].tolist())], "id string, e array<float>")
    got = {}
    for r in vectors.nearest(df, "id", "e", 32).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    want = brute_neighbours(v.astype(np.float64), 5)
    assert set(got) == set(range(1500)) and all(i not in s and len(s) == 5 for i, s in got.items())
    assert np.mean([len(got[i] & want[i]) / 5 for i in range(1500)]) >= 0.95


def test_two_levels_of_cells_and_split_files(spark, monkeypatch):
    """Cells beyond the first codebook, files far smaller than a cell and few candidates at a time: the same recall."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    v = (centres[rng.integers(0, 12, 2400)] + 0.4 * rng.normal(size=(2400, 32))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", x.tolist()) for i, x in enumerate(v)], "id string, e array<float>")
    for name, value in (("FIRST_WORDS", 3), ("CELL_ROWS", 200), ("FILE_ROWS", 40), ("AT_ONCE", 300)):
        monkeypatch.setattr(vectors, name, value)
    books = vectors.Codebooks.fit(v, 2400)
    assert books.cells == 12 and len(books.first) == 3
    got = {}
    for r in vectors.nearest(df, "id", "e", 32).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    want = brute_neighbours(v.astype(np.float64), 5)
    assert set(got) == set(range(2400)) and all(len(s) == 5 for s in got.values())
    assert np.mean([len(got[i] & want[i]) / 5 for i in range(2400)]) >= 0.95


def test_many_small_clusters_beyond_the_sample(spark, monkeypatch):
    """More clusters than the sample knows, many in a cell: a block's votes leave most of a query's neighbours out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 64))
    v = (centres[rng.permutation(np.repeat(np.arange(200), 25))] + 0.6 * rng.normal(size=(5000, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", x.tolist()) for i, x in enumerate(v)], "id string, e array<float>")
    for name, value in (("FIT_ROWS", 200), ("CELL_ROWS", 50)):
        monkeypatch.setattr(vectors, name, value)
    got = {}
    for r in vectors.nearest(df, "id", "e", 64, probes=3).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    want = brute_neighbours(v.astype(np.float64), 5)
    assert set(got) == set(range(5000)) and all(len(s) == 5 for s in got.values())
    recall = np.mean([len(got[i] & want[i]) / 5 for i in range(5000)])
    assert recall >= 0.95, recall


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 16)).astype(np.float32)
    rows = [(f"{i:05d}", (v[0] if i % 3 == 0 else v[i % 200]).tolist()) for i in range(600)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "id string, e array<float>"), "id", "e", 16).collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.similarity, 5)))
    assert len(got) == 600 and all(len(x) == 5 for x in got.values())
    assert all(s == 1.0 for i in range(0, 600, 3) for _, s in got[f"{i:05d}"])


def test_nearest_of_few_and_none(spark):
    one = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id string, e array<float>")
    assert {(r.id, r.neighbour) for r in vectors.nearest(one, "id", "e", 2).collect()} == {("x", "y"), ("y", "x")}
    assert vectors.nearest(one.limit(0), "id", "e", 2).count() == 0


def test_the_fullest_row_is_completed(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2020, 1, k)
    rows = [("a", "g", "T", None, 0, "10.1/x", day(1)), ("b", "g", "T one", "A; B", 2001, None, day(2)), ("c", "g", "", " ", None, "", day(3)), ("d", "h", None, None, None, None, None)]
    got = {r.g: (r.title, r.authors, r.year, r.doi) for r in survivors.fullest(spark.createDataFrame(rows, "id string, g string, title string, authors string, year int, doi string, created_at timestamp"), "g", ["title", "authors", "year", "doi"]).collect()}
    assert got == {"g": ("T one", "A; B", 2001, "10.1/x"), "h": (None, None, None, None)}
