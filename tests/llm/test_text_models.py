import functools
import itertools
import random
from collections import Counter

import pytest

pytest.importorskip("quillspark.llm")

from quillspark.llm import bpe, leakage, scans, sentences, truncation  # noqa: E402


# ---- truncation ----
CUT = ["The entity linker delays the argument gra", "We report 3 cases in which the", "A gain of points […]", "It fades on l (truncated)", "so [cut]", "peer inde... Read more", "w&am", "in linguistics w\\u00", 'called it "a battery cell!', "(why not the other", "compared by Ms.", "cf. Fig.", "and so on…", "the antenn(", "The ice core (why not the other?)", "cf. Fig. 3 and Eq. (12)"]
WHOLE = [None, "", "   ", "One.", "Why did it fail?!", "It held. (ice core)", "No abstract available.", '"Is it enough?" they asked after the round.', "为何如此？", "यह है।"]


@pytest.mark.parametrize("text", CUT)
def test_cut_ends(text):
    assert truncation.judge(text)[0] in ("cut", "bare")


@pytest.mark.parametrize("text,is_open", [("It was seen <i>here.", True), ("It was seen <i>here</i>.", False), ("Line one.<br>Line two.", False), ("x < y and y > z.", False), ("It was <b>seen <i>here</b>.", False), ("See <a href='x'>this</a> and <su", True), ("a <sub>2</sub> b.", False)])
def test_markup_on_the_stack(text, is_open):
    assert truncation.unclosed(text) == is_open


def test_a_source_without_stops_is_no_cut_source(spark):
    """Where no text has a terminator, only a length limit or a broken word tells."""
    titles = ["Annual River Survey 2019", "Ice core handbook", "Kelp bed atlas", "River ice handbook", "Survey of kelp"]
    rows = [("t", f"a{k}", "titles", titles[k % 5]) for k in range(40)] + [("t", "a-cut", "titles", "Annual River Surv")]
    rows += [("t", f"b{k}", "texts", "We used the handbook. It is the Ice atlas. See kelp, 2019, and so on.") for k in range(40)] + [("t", "b-cut", "texts", "We used the handbook")]
    got = {r.record_key: r.is_cut for r in truncation.judged(spark.createDataFrame(rows, "tbl string, record_key string, source string, text string")).collect()}
    assert {k for k, v in got.items() if v} == {"a-cut", "b-cut"}


@pytest.mark.parametrize("text", WHOLE)
def test_whole_ends(text):
    assert truncation.judge(text)[0] == "whole"


def test_numbers_and_lists_are_decided_by_the_corpus(spark):
    body = "Results show a gain of 3.4 points over others. Keywords: ice core, kelp bed"
    rows = [("t", str(i), "s", body) for i in range(6)] + [("t", "n", "s", "Results show a gain of 3."), ("t", "r", "s", "It was left in round 4. It was left in round 4."), ("t", "l", "s", "Fine. Keywords: ice core, gla"), ("t", "e", None, None)]
    rows += [("t", f"q{i}", "s", f"It was left in round {i}. The kelp bed, it is a kelp bed. So.") for i in range(3)]
    got = {r.record_key: r.is_cut for r in truncation.judged(spark.createDataFrame(rows * 2, "tbl string, record_key string, source string, text string")).collect()}
    rows = [("t", str(i), "s", 'They wrote: "It holds." Then "Is it enough?" they asked. One called it "a cell!" and left.') for i in range(5)] + [("t", "a", "s", 'They wrote: "It holds."'), ("t", "b", "s", 'It was so. "Is it enough?"'), ("t", "c", "s", 'One called it "a cell!"')]
    quotes = {r.record_key: r.is_cut for r in truncation.judged(spark.createDataFrame(rows, "tbl string, record_key string, source string, text string")).collect()}
    assert quotes["c"] and not quotes["a"]
    assert got["n"] and got["l"] and not got["r"] and not got["0"] and not got["e"] and len(got) == 13


def test_truncation_of_an_empty_table(spark):
    assert truncation.judged(spark.createDataFrame([], "tbl string, record_key string, source string, text string")).count() == 0


# ---- tokens ----
def texts():
    rng = random.Random(3)
    pool = ["the river ", "Δelta ", "日本語テキスト", "naïve café ", "\n\n  ", "\t", "<|endoftext|>", "don't we'll ", "1234567 3.14 ", "🌊🧪", "हिन्दी ", "aaaaaaaa", "‍\x00", "ไทยทดสอบ "]
    return [None, "", " ", "a", "x" * 5000, *["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(300)]]


def test_ids_equal_the_reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    ts = texts()
    want = [e.ids for e in t.encode_batch([x or "" for x in ts], add_special_tokens=False)]
    assert [list(map(int, x)) for x in bpe.MergeReplay().encode(ts)] == want


def test_round_trip(spark):
    import json

    vocab = json.load(open(bpe.DEFAULT_VOCABULARY, encoding="utf-8"))["model"]["vocab"]
    letter = {c: i for i, c in enumerate(bpe._byte_letters())}
    byte = {i: bytes(letter[c] for c in s) for s, i in vocab.items() if all(c in letter for c in s)}
    ts = texts()
    got = {r.k: r.ids for r in bpe.encode_corpus(spark.createDataFrame([(i, t, "x") for i, t in enumerate(ts)], "k long, t string, ids string"), "k", "t", chars=500).collect()}
    assert len(got) == len(ts) and all(b"".join(byte[i] for i in got[k]).decode() == (t or "") for k, t in enumerate(ts))


# ---- leakage ----
def brute_leaks(docs, items, least):
    import regex

    w = lambda t: regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*", (t or "").lower())
    out = set()
    for i, t in items:
        x = w(t)
        grams = {tuple(x[k : k + least]) for k in range(len(x) - least + 1)}
        for d, s in docs:
            y = w(s)
            if any(tuple(y[k : k + least]) in grams for k in range(len(y) - least + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta the of and".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 20)))) for i in range(12)] + [(90, None), (91, "")]
    items[3] = (3, items[2][1])
    docs = []
    for d in range(120):
        t = [word() for _ in range(rng.randrange(0, 30))]
        if d % 3 == 0:
            x = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(x))
            t[2:2] = x[a : a + rng.randrange(1, 12)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(t).upper() if d % 5 == 0 else " ".join(t)))
    docs += [(900, None), (901, ""), (902, " ".join(["the"] * 20_000))]
    s = spark.createDataFrame([(*x, 1) for x in docs + docs[:10]], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(s, spark.createDataFrame(items, "item_id long, text string"), 5).collect()}
    assert got == brute_leaks(docs, items, 5)
    assert leakage.leaks(s.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def brute_near(doc, item, least, core, gap, run):
    """The most agreeing words in a passage, by trying every chain of runs."""
    found = []
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and not (i and j and doc[i - 1] == item[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= run:
                    found.append((i, j, n))
    return found


def test_proximity_bridges_gaps(spark):
    words = [f"w{k}" for k in range(40)]
    one_in = words[:8] + ["x"] + words[8:16]
    one_out = words[:7] + words[8:16]
    changed = words[:6] + ["y"] + words[7:16]
    far = words[:8] + ["x"] * 5 + words[8:14]
    short = words[:6] + ["x"] + words[6:10]
    few = [w for k in range(0, 40, 4) for w in (words[k], words[k + 1], words[k + 2], "z")]  # no run of six
    docs = [(k, " ".join(["pre"] * k + d + ["post"])) for k, d in enumerate([one_in, one_out, changed, far, short, few, words])] + [(90, None), (91, "")]
    got = {r.doc_id: (r.start_word, r.end_word, r.words) for r in leakage.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words)), (2, None)], "item_id long, text string")).collect()}
    assert got == {0: (0, 17, 16), 1: (1, 16, 15), 2: (2, 18, 15), 6: (6, 46, 40)}
    assert brute_near(one_in, words, 12, 6, 3, 3) == [(0, 0, 8), (9, 8, 8)]


def test_shuffled_items_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = spark.createDataFrame([(k, text(12)) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, text(400)) for k in range(20)], "doc_id long, text string")
    rows = lambda: sorted(tuple(r) for r in leakage.leaks(docs, items, 4).collect())
    whole = rows()
    monkeypatch.setattr(leakage, "SENT_ROWS", 0)
    assert rows() == whole and len(whole) > 50


# ---- scans ----
def test_context_decides_for_a_rarer_word(spark):
    texts = ["sheets fall here and they fall here"] * 150 + ["they may fail here"] * 30 + ["they may fa1l here", "sheets fa1l here"]
    rows = [("document_chunks", str(k), t, None) for k, t in enumerate(texts)]
    got = {(r.record_key, r.repaired) for r in scans.repairs(spark.createDataFrame(rows, "tbl string, record_key string, text string, title string")).collect()}
    assert got == {("180", "fail"), ("181", "fall")}


@pytest.mark.parametrize("line", ["Smith et al", "Smith et @1.,", "Smith et aI.,", "Smith ct al.", "Polar Research,v0l. 7", "Ice Sheets\t\t12", "- - - - - - - 12 - - - - - - -"])
def test_furniture_by_pattern(line):
    assert scans.furniture(["The text runs on here", line, "and goes on after it."])[1]


@pytest.mark.parametrize("title,header", [("Common errors in modern models", "Cornmon errors in modern models"), ("Common errors in modern models of drifting sea ice and of the seasons", "Comrnon errors in modern models of drifting sea ice and of the seasons"), ("Wide drains under the old wall", "vvide drains under the old wall")])
def test_misread_titles_are_furniture(title, header):
    lines = ["some text of the page before", header, "and it goes on here for a while", "until it ends."]
    assert scans.furniture(lines, (title,)) == [False, True, False, False]


def test_a_title_under_its_cut_header_is_no_furniture():
    title = "Athesel: Molecular dosage plan for contrastive sensor array in networks of cells"
    lines = [title.upper()[:46], title, "some text of the page", "until it ends."]
    assert scans.furniture(lines) == scans.furniture(lines, (title,)) == [True, False, False, False]
    assert scans.title_of("\n".join(lines)) == title


def test_the_cheap_test_is_necessary():
    rng = random.Random(4)
    words = "common modern errors drain wall ice sheet models under the old season of drifting".split()
    met = 0
    for _ in range(3000):
        a = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9)))
        b = a
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b))
            b = b[:k] + rng.choice(["", "rn", "x", "@"]) + b[k + 1 :]
        if scans._alike(a, b):
            met += 1
            assert scans._may_be_alike(a, b)
    assert met > 500


def test_furniture():
    lines = ["Journal of Polar Research, vol. 2", "A spatial approach to glacier flow and ice", "Methods", "We saw", "- 1 -", "Page 2", "[3]", "l1", "1 | Beleso", "van Mared et al.", "2  Annals of Tidal Ecology", "0.96 9.0", "3 Results", "the topic of St. Ivarra, vol. 3", ""]
    got = [l for l, f in zip(lines, scans.furniture(lines)) if f]
    assert got == ["Journal of Polar Research, vol. 2", "- 1 -", "Page 2", "[3]", "l1", "1 | Beleso", "van Mared et al.", "2  Annals of Tidal Ecology"]


def brute_candidates(word, vocabulary, most=3):
    """All words reached by replacing up to ``most`` confusions, by trying each."""
    seen, todo = {word: 0}, [word]
    for _ in range(most):
        new = []
        for w in todo:
            for true, s in scans.CONFUSIONS:
                at = w.find(s.lower())
                while at >= 0:
                    x = w[:at] + true + w[at + len(s) :]
                    if x not in seen:
                        seen[x] = 1
                        new.append(x)
                    at = w.find(s.lower(), at + 1)
        todo = new
    return {w for w in seen if w in vocabulary and w != word}


def test_automaton_finds_every_candidate():
    vocabulary = dict.fromkeys("clustered modern dampens outlasts knowledge limitation stochastic image graph multilingual corner burned".split(), 100)
    trie = scans.Trie(vocabulary)
    for seen in ["dustered", "darnpens", "oiitlasts", "kn0wledge", "1imitation", "5tochastic", "irnage", "gr@ph", "multilmgual", "bumed", "zzz"]:
        assert brute_candidates(seen, vocabulary, 2) <= set(trie.candidates(seen))


@pytest.mark.parametrize("seen,right", [("knowlege", "knowledge"), ("knowlledge", "knowledge"), ("rivr", "river"), ("riber", "river"), ("climat", "climate"), ("xclimate", "climate"), ("limate", "climate")])
def test_automaton_takes_every_edit(seen, right):
    assert right in scans.Trie(dict.fromkeys(["knowledge", "river", "climate"], 100)).candidates(seen)


def test_automaton_equals_brute_force_edit_distance():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abe") for _ in range(rng.randrange(3, 8)))
    vocabulary = dict.fromkeys({word() for _ in range(300)}, 100)
    trie = scans.Trie(vocabulary)

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]

    for _ in range(200):
        w = word()
        if len(w) >= 4:
            assert {v for v in vocabulary if one_edit(w, v)} <= set(trie.candidates(w))


def test_shards_and_bitmaps_change_nothing(spark, monkeypatch):
    words = "clustered modern dampens outlasts knowledge limitation stochastic image graph multilingual corner burned".split()
    seen = ["dustered", "darnpens", "oiitlasts", "kn0wledge", "1imitation", "5tochastic", "irnage", "gr@ph", "multilmgual", "bumed", "zzz", "no"]
    asked = spark.createDataFrame([(w, 1) for w in seen], "word string, n long")
    known = spark.createDataFrame([(w, 500) for w in words], "word string, n long")
    rows = lambda: sorted(tuple(r) for r in scans.look_up(asked, known).collect())
    whole = rows()
    monkeypatch.setattr(scans, "SHARD_WORDS", 3)
    monkeypatch.setattr(scans, "PART_WORDS", 2)
    assert rows() == whole and len({w for w, _, _ in whole}) == 10
    bits = scans.bitmap(asked, "word")
    assert all(scans._has(bits, w) for w in seen) and not scans._has(bits, "modern") and len(bits) == 1 << 23


def test_reflow(spark):
    text = "Annals of Tidal Ecology, vol. 2\nHow ice moves\n1 Methods\nThe rnodern clus-\n- 1 -\nter (darnpens, the) kn0wledge base, and the\nimage outlasts it.\n\nIt ends here."
    items = [("furniture", 1, "", ""), ("furniture", 5, "", ""), ("glyph", 4, "rnodern", "modern"), ("break", 4, "cluster", "cluster"), ("glyph", 6, "darnpens", "dampens"), ("glyph", 6, "kn0wledge", "knowledge")]
    want = ["How ice moves", "1 Methods", "The modern cluster (dampens, the) knowledge base, and the image outlasts it.", "It ends here."]
    assert scans.reflow(text, items) == want and scans.reflow("", []) == []
    rows = spark.createDataFrame([("t", "a", text, None), ("t", "a", text, None), ("t", "b", "", None), ("t", "c", None, None)], "tbl string, record_key string, text string, title string")
    found = spark.createDataFrame([("t", "a", *i) for i in items], "tbl string, record_key string, item_kind string, line_no long, found string, repaired string")
    assert [(r.paragraph_no, r.text) for r in scans.reflowed(rows, found).orderBy("paragraph_no").collect()] == list(enumerate(want, 1))


def test_the_title_is_looked_for_in_the_whole_text():
    assert scans.title_of("\n" * 3000 + "- 1 -\n" * 40 + "Page 2\nSmith et al.\nHow ice moves\nand so on.") == "How ice moves"
    assert scans.title_of("") == scans.title_of("\n \n") == ""


def test_repairs(spark):
    good = "The modern cluster dampens the knowledge base and the image outlasts the long-term graph kernel in robotics. " * 200
    noisy = "Annals of Tidal Ecology, vol. 2\nA spatial approach to ice\nThe rnodern clus-\n- 1 -\nter darnpens the kn0wledge base, and the long-\nterm irnage outlasts it."
    docs = spark.createDataFrame([("a", good), ("b", noisy), ("b", noisy), ("c", None), ("d", "")], "id string, content string")
    chunks = spark.createDataFrame([("k", "b", "The gr@ph kernel\n[2]"), ("l", None, "fine")], "id string, document_id string, text string")
    got = {(r.tbl, r.item_kind, r.line_no, r.repaired) for r in scans.repairs(scans.with_titles(docs, chunks)).distinct().collect()}
    d, c = "paper_documents", "document_chunks"
    assert got == {(d, "furniture", 1, ""), (d, "furniture", 4, ""), (d, "break", 3, "cluster"), (d, "glyph", 3, "modern"), (d, "glyph", 5, "dampens"), (d, "glyph", 5, "knowledge"), (d, "break", 5, "long-term"), (d, "glyph", 6, "image"), (c, "glyph", 1, "graph"), (c, "furniture", 2, "")}


def test_repairs_of_empty_tables(spark):
    docs, chunks = spark.createDataFrame([], "id string, content string"), spark.createDataFrame([], "id string, document_id string, text string")
    assert scans.repairs(scans.with_titles(docs, chunks)).count() == 0


# ---- sentences ----
CORPUS = (
    ["We saw Dr. Marvik in round 5.", "It rose by 3.4 points, cf. Fig. 3 and Eq. (4).", "It was seen in the Quorra Plain.", "The bird came back.", "They left at night."] * 6
    + ["Am 5. Mai begann es, wie Dr. Yarnov sagt.", "Das Ergebnis ist klar.", "Im 7. Kapitel steht der Rest."] * 8
    + ["วันนี้ฝนตกหนัก", "แมวดำนอนหลับ", "เราใช้ 23 ตัวอย่าง"] * 8
)


QUOTED = [
    'They said: "It came back at night." Then they left. The bird (as in round 5.) rose.', '"It rose. We saw it," said Dr. Yarnov at night. They left. "Is it back?" they asked. It was.',
    'The panel called it "a bird!" and left. Did it rise?! It did. Was it so? It was! They left.', "“够了。”他们说。他写道：“很好。” 结果是好的！真的吗？是的。", "（全部。）结果是好的。「足りる。」と述べた。良い！",
    "2. Methods\n\nIt was so. They left.\n\n3. Ergebnis\n\nIt rose. They left.", "(It was seen.) They left at night. The bird (why not?) came back. (All of it.) It was so.",
]


@functools.cache
def model():
    c: Counter = Counter()
    for t in CORPUS:
        sentences.learn(t, c)
    keys = sentences.Keys({k: (c[k, True], c[k, False]) for k in {k for k, _ in c}}, 0.6, 0.6)
    rng = random.Random(2)
    latin, thai = [t for t in CORPUS if t.isascii()], [t for t in CORPUS if "ก" <= t[0] <= "๙"]
    texts = ["\n\n".join(" ".join(rng.sample(pool, rng.randrange(1, 3))) for _ in range(4)) for pool in (latin, thai) for _ in range(60)] + QUOTED * 10
    return sentences.Model(keys, sentences.Chain.fit([x for t in texts for x in sentences.training(t, keys)]))


def units(text):
    return [text[a:b] for a, b in sentences.split(text, model())]


@pytest.mark.parametrize("want", [
    ["We saw Dr. Marvik in round 5.", "The bird came back."],
    ["Am 5. Mai begann es, wie Dr. Yarnov sagt.", "Das Ergebnis ist klar."],
    ['"It failed. We left it there," said Dr. Marvik in round 5.', "They left at night."],
    ['The panel wrote: "The bird came back."', "They left at night."],
    ['One called it "a cell!" and moved on.', "Why did it fail?!", "They left at night."],
    ["The rock (why not the other?) was seen in the Quorra Plain.", "(All of it came back.)", "They left at night."],
    ["“够用吗？”审稿人问道。", "作者写道：“这很好。”", "结果惊人！"], ["「足りるか。」と査読者は尋ねた。", "驚くべき結果である！"],
])
def test_units(want):
    sep = "" if any("぀" <= ch <= "鿿" for ch in "".join(want)) else " "
    assert units(sep.join(want)) == want


def test_units_without_full_stops():
    assert units("วันนี้ฝนตกหนัก แมวดำนอนหลับ เราใช้ 23 ตัวอย่าง") == ["วันนี้ฝนตกหนัก", "แมวดำนอนหลับ", "เราใช้ 23 ตัวอย่าง"]


def test_lines_and_headings():
    assert units("1. Einleitung\nDas Ergebnis ist klar.") == ["1. Einleitung", "Das Ergebnis ist klar."]
    wrapped = "It was seen in the Quorra Plain and the bird came\nback to the place where it had been before that\nday came. They left at night."
    assert units(wrapped) == [wrapped[: wrapped.index("They") - 1], "They left at night."]
    assert units("") == units(None) == units(" \n\t") == []


def test_spans(spark):
    rows = [(1, "  The bird came back.  They left at night.\r\n", 0), (2, None, 0), (3, "", 0), (4, "It was so. " * 5000, 0)]
    got = sentences.sentence_spans(spark.createDataFrame(rows, "doc_id long, text string, start_char int"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.start_char, r.end_char) for r in got if r.doc_id == 1) == [(1, 2, 21), (1, 23, 42)]
    assert sum(r.doc_id == 4 for r in got) == 5000 and not any(r.doc_id in (2, 3) for r in got)
    assert sentences.sentence_spans(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_held_out_accuracy():
    """Trained on single sentences, measured on paragraphs drawn from them."""
    rng = random.Random(4)
    tests = [[rng.choice(CORPUS[:30]) for _ in range(rng.randrange(2, 7))] for _ in range(200)]
    assert sum(units(" ".join(p)) == p for p in tests) / len(tests) > 0.95


def chains(many, seed):
    """Sequences in which the emission says little and a boundary never follows a brief gap after a boundary."""
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        f, g, y, before = [], [], [], 1
        for _ in range(8):
            gap = rng.choice(["brief", "much"])
            tag = 0 if gap == "brief" and before else int(rng.random() < 0.85)
            sure = rng.random() < 0.6
            f.append([("mark", 1.0)] + ([("word", 1.0 if tag else -1.0)] if sure else []))
            g.append(gap)
            y.append(tag)
            before = tag
        out.append((f, g, y))
    return out


def test_decoding_uses_transitions():
    rng = random.Random(8)
    hidden = [(f, g, [t if rng.random() < 0.5 else -1 for t in y]) for f, g, y in chains(400, 1)]
    chain = sentences.Chain.fit(hidden)
    assert chain.move["brief"][3] < chain.move["much"][3] - 2  # boundary after boundary over a brief gap
    right = wrong = 0
    for f, g, y in chains(200, 2):
        emit = chain.scores(f)
        got, cut = chain.viterbi(emit, g), [int(s > 0) for s in emit]
        right += sum(a != b and a == t for a, b, t in zip(got, cut, y))
        wrong += sum(a != b and b == t for a, b, t in zip(got, cut, y))
    assert right > 5 * wrong and right > 100


def test_viterbi_is_the_best_path():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 8)
        move = {g: tuple(rng.gauss(0, 2) for _ in range(4)) for g in "ab"}
        emit, gaps = [rng.gauss(0, 2) for _ in range(n)], [rng.choice("ab") for _ in range(n)]
        worth = lambda y: sum(move[g][2 * p + q] + (e if q else 0.0) for p, q, g, e in zip((1, *y), y, gaps, emit))
        assert tuple(sentences.Chain({}, move).viterbi(emit, gaps)) == max(itertools.product((0, 1), repeat=n), key=worth)


def test_a_model_without_texts():
    keys = sentences.Keys({}, 0.5, 0.5)
    assert sentences.split("One. Two.", sentences.Model(keys, sentences.Chain.fit([]))) == [(0, 9)]
