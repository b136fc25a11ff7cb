"""Inputs that are long, deep, or broken: each has a defined result, in time linear in its length."""

import random
import time

import numpy as np
import pytest

from quern.llm import html_extract, packing, pii, run_index, substring_dedup

PROSE = "<p>The story, as it is told, goes on, and on, and ends well, as it should, for all of them who hear it.</p>"
SAID = PROSE[3:-4]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 3_000_000, "a" + " \t" * 500_000 + "b", "a " * 1000 + " " * 60_000 + "<|endoftext|>"])
def test_packing_of_blanks(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    assert packing.encoder(packing.default_vocabulary())([text])[0] == own.encode(text, add_special_tokens=False).ids


def test_packing_of_a_blank_document(spark):
    found = packing.pack(spark.createDataFrame([(1, " " * 1_000_000), (2, "word")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in found if r["doc_id"] == 1) == 1_000_001


def test_packing_of_another_vocabulary_falls_back(tmp_path):
    """Settings that tiktoken does not know send every text through tokenizers."""
    import json

    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing._ranks(spec) is not None
    for place, name, value in (("pre_tokenizer", "use_regex", False), ("pre_tokenizer", "add_prefix_space", True), ("model", "byte_fallback", True), ("model", "end_of_word_suffix", "</w>")):
        assert packing._ranks(spec | {place: spec[place] | {name: value}}) is None
    assert packing._ranks(spec | {"truncation": {"max_length": 5}}) is None


def histogram(seed: int) -> dict[int, int]:
    rng = random.Random(seed)
    return dict(zip(*np.unique([min(1024, max(1, int(rng.lognormvariate(5.8, 0.9)))) for _ in range(20_000)], return_counts=True), strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_few_groups_pack_nearly_as_well_as_whole_lengths(seed):
    """64 groups come within half a per cent of the bound, and no piece is lost or doubled."""
    lengths = {int(k): int(n) for k, n in histogram(seed).items()}
    runs = packing.pack_histogram(lengths)
    held: dict[int, int] = {}
    for run in runs:
        assert sum(k for k, _ in run.items) == 1024 - run.room
        for k, _ in run.items:
            held[k] = held.get(k, 0) + run.count
    assert held == lengths
    bound = -(-sum(k * n for k, n in lengths.items()) // 1024)
    assert sum(run.count for run in runs) <= 1.005 * bound + 2


def test_configurations_are_optimal_on_small_instances():
    """The linear programme's cost is at most that of the best whole solution, and within a sequence a size of it."""
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted(rng.sample(range(4, 12), 3), reverse=True)
        counts = [rng.randint(1, 3) for _ in sizes]
        found = packing.configurations(sizes, counts, 12)
        for pattern, _ in found:
            assert (pattern * sizes).sum() <= 12
        assert np.allclose(sum(p * a for p, a in found), counts)
        items = sorted([x for x, n in zip(sizes, counts, strict=True) for _ in range(n)], reverse=True)

        def fewest(k, rooms):
            if k == len(items):
                return len(rooms)
            best = fewest(k + 1, [*rooms, 12 - items[k]])
            for i, room in enumerate(rooms):
                if room >= items[k]:
                    best = min(best, fewest(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]]))
            return best

        cost = sum(a for _, a in found)
        assert cost <= fewest(0, []) + 1e-9 <= cost + len(sizes)


def test_html_without_head_end():
    for page in (f"<head><title>T</title><body><article>{PROSE * 3}</article>", f"<html><head><meta charset=x><title>T</title><div>{PROSE * 3}</div></html>", f"<head><title>T</title>{PROSE * 3}"):
        assert html_extract.extract(page, []) == "\n".join([SAID] * 3)


def test_html_deep_pages(spark):
    deep = "<div>" * 3000 + PROSE + "</div>" * 3000
    pages = spark.createDataFrame([(i, "http://deep/x", deep) for i in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.main_text(pages).collect()} == {SAID}


def test_html_sections_of_an_article_stay():
    """Names that sections of articles have take out what holds no prose, and reader comments always go."""
    long = "<p>" + SAID * 3 + "</p>"
    for name in ("legal", "discussion", "related-work", "search-results", "tags", "share-capital"):
        page = f'<body><article>{long}<section class="{name}"><h2>Part</h2>{long}</section><div class="{name}"><a href="/a">x</a> and y</div></article></body>'
        assert html_extract.extract(page, []) == "\n".join([SAID * 3, "Part", SAID * 3])
    for name in ("comments", "ad", "cookie-notice", "newsletter"):
        assert html_extract.extract(f'<body><article>{long}<section class="{name}">{long}</section></article></body>', []) == SAID * 3


def test_html_broken_tags():
    cases = {
        f"<body><article>{PROSE}<p>1 < 2 and <3, a<b": SAID + "\n1 < 2 and <3, a",
        f'<body><article>{PROSE}<p title="a > b">x, y, z</p><p class=a"b>q, r, s</p>': SAID + "\nx, y, z\nq, r, s",
        f"<body><article>{PROSE}<!--><p>shown</p><!-- --><p>too</p><!-- never": SAID + "\nshown\ntoo",
        f"<body><article>{PROSE}<script>if (a < b) '</scripts>'</script ><p>after</p>": SAID + "\nafter",
        f"<body><article>{PROSE}<style>p {{": SAID,
    }
    for page, want in cases.items():
        assert html_extract.extract(page, []) == want


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<!--", '<p a="', "</p", "<", "&", "<li>x", '<div class="c"><p>x, y</p></div>'])
def test_html_time_is_linear(unit):
    def took(n):
        start = time.process_time()
        found = html_extract.vote(unit * n)
        html_extract.extract(unit * n, [found[0]] if found else [])
        return time.process_time() - start

    n = 100_000 // len(unit)
    small = took(n)
    assert took(4 * n) <= 8 * small + 0.5


def test_pii_of_leading_zeros():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    assert pii.base_spans("0" * 5000 + "256.1.1.1") == []
    assert pii.base_spans("1.2.3." + "0" * 9000) == [(0, 9006, "ip")]


@pytest.mark.parametrize("unit", ["0", "1.", "123 456 ", "a@b.cc ", "@", "a at b dot ", "+1 ", "4 "])
def test_pii_time_is_linear(unit):
    weights = pii.trained()

    def took(n):
        start = time.process_time()
        pii.added_spans(unit * n, pii.base_spans(unit * n), weights)
        return time.process_time() - start

    n = 100_000 // len(unit) // (16 if unit == "123 456 " else 1)
    small = took(n)
    assert took(4 * n) <= 8 * small + 0.5


# Written by hand, none of it by the generator that the model is trained on.
PERSONAL = [
    ("Ring Ann on (212) 555-0147 after six.", "(212) 555-0147"), ("Tel. 415-555-0132, ask for Jo", "415-555-0132"), ("fax: 020 7946 0958", "020 7946 0958"),
    ("mobile 07700 900123 please", "07700 900123"), ("write to jane.doe (at) example (dot) org", "jane.doe (at) example (dot) org"), ("mail bob at example dot com today", "bob at example dot com"),
    ("contact: sales[at]shop[dot]net", "sales[at]shop[dot]net"), ("info @ museum.org is read daily", "info @ museum.org"), ("card 3782 822463 10005 expires 10/27", "3782 822463 10005"),
    ("amex 378282246310005.", "378282246310005"), ("paid with 4111.1111.1111.1111 yesterday", "4111.1111.1111.1111"), ("visa 4222222222222 (13 digits)", "4222222222222"),
    ("Call 1-800-555-0199 or 1-888-555-0100", "1-800-555-0199"), ("ph 512.555.0170 ext 4", "512.555.0170"), ("my number's 646 555 0188, text me", "646 555 0188"),
    ("reach me: 303-555-0121 / 303-555-0122", "303-555-0122"), ("kim AT lab DOT edu", "kim AT lab DOT edu"), ("(650) 555 0111 is the desk", "(650) 555 0111"), ("Phone:503-555-0156", "503-555-0156"),
    ("ana(at)correo(dot)es", "ana(at)correo(dot)es"),
]
CLEAN = [
    "Released 2024-03-15 at 10:45:00 UTC.", "ISBN 978-3-16-148410-0 is in print", "invoice 20231107-0042 for $1,299.00", "version 10.4.2.1999 of the tool", "order no. 100200300 shipped",
    "pi = 3.14159265358979", "chapters 12-14, pages 100-120", "lat 48.8566, lon 2.3522", "tracking 1Z 999 AA1 01 2345 6784", "the years 1914 1918 1939 1945", "scores 3 2, 1 0 and 4 4",
    "meet at noon. dot your i's", "look at example. dot matrix", "Section 4.1.2.3 applies", "0.0001 0.0002 0.0003 0.0004", "population 1 234 567 890 in 2020", "UUID 123e4567-e89b-12d3-a456-426614174000",
    "MAC 00:1B:44:11:3A:B7", "isotopes 235 238 239", "at 5 dot 30 we left", "RFC 2616, 7230-7235", "12 34 56 78 90 12", "phone number unknown", "1111 2222 3333 4445", "2,147,483,647 bytes",
]


def test_pii_recall_and_precision_of_added_spans():
    weights = pii.trained()
    found = [want in [t[a:b] for a, b, _ in pii.added_spans(t, pii.base_spans(t), weights)] for t, want in PERSONAL]
    assert sum(found) >= 0.75 * len(PERSONAL)
    assert not [t for t in CLEAN if pii.added_spans(t, pii.base_spans(t), weights)]


def segmentations(n, spans):
    """Every segmentation as its entities: (place in spans, kind)."""
    def go(k):
        if k == n:
            yield []
            return
        for rest in go(k + 1):
            yield rest
        for x, (i, j, _) in enumerate(spans):
            if i == k:
                for kind in range(2):
                    for rest in go(j):
                        yield [(x, kind), *rest]

    return list(go(0))


def test_semi_markov_against_enumeration():
    """Sums, the best path and its entities' log-odds agree with an enumeration of all segmentations."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 7))
        spans = sorted({(int(i), int(min(n, i + rng.integers(1, 4)))) for i in rng.integers(0, n, 4)})
        spans = [(i, j, []) for i, j in spans]
        scores, moves, between = rng.normal(0, 2, (len(spans), 2)), rng.normal(0, 1, (3, 2)), list(rng.random(n) < 0.5)

        def worth(path):
            total, at, state = 0.0, 0, 0
            for x, kind in path:
                i, j, _ = spans[x]
                state = state if all(between[at:i]) else 0
                total += scores[x][kind] + moves[state, kind]
                at, state = j, kind + 1
            return total

        every = segmentations(n, spans)
        log_total = np.logaddexp.reduce([worth(p) for p in every])
        behind, ahead = pii.forward(n, spans, scores, moves, between), pii.backward(n, spans, scores, moves, between)
        assert np.logaddexp.reduce(behind[n]) == pytest.approx(log_total) and ahead[0, 0] == pytest.approx(log_total)
        path = pii.viterbi(n, spans, scores, moves, between)
        assert worth(path) == pytest.approx(max(map(worth, every)))
        for (x, kind), odds in zip(path, pii.log_odds(spans, scores, path, behind, ahead, moves), strict=True):
            p = sum(np.exp(worth(q) - log_total) for q in every if (x, kind) in q)
            assert odds == pytest.approx(np.log(p / (1 - p)), abs=1e-6)


def test_stretches_change_nothing(monkeypatch):
    """A window decoded in stretches has the entities of the window decoded whole."""
    weights, rng = pii.trained(), random.Random(4)
    texts = [" so ".join(pii.generated(rng)[0] for _ in range(3)) for _ in range(60)]
    parts = [pii.decode(t, weights) for t in texts]

    def whole(text, edges, between):
        spans = list(pii._candidates(text, edges))
        return [(0, len(edges) - 1, spans)] if spans else []

    monkeypatch.setattr(pii, "_stretches", whole)
    assert parts == [pii.decode(t, weights) for t in texts]


def test_run_index_is_run_sized_and_needs_every_sample():
    """Runs stay few where texts repeat, and without a sampled run end repeats are missed or invented."""
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcdefghij ") for _ in range(400))
    texts = []
    for _ in range(200):
        text = bytearray(base)
        text[rng.randrange(400)] = ord("x")
        texts.append(bytes(text))
    index = run_index.RunIndex(texts, 100, [301] * 200)
    assert len(index.symbol) == len(index.sample_first) == len(index.sample_last) == len(index.first) < index.size / 20
    whole = [f.tolist() for f in index.repeated()]
    seen, want = set(), []
    for text in texts:
        want.append([p for p in range(301) if text[p : p + 100] in seen])
        seen |= {text[p : p + 100] for p in range(301)}
    assert whole == want
    changed = 0
    for name in ("sample_first", "sample_last"):
        for k in rng.sample(range(len(index.symbol)), 40):
            sample = getattr(index, name)
            old, sample[k] = sample[k], 1
            changed += [f.tolist() for f in index.repeated()] != whole
            sample[k] = old
    assert changed >= 40 and [f.tolist() for f in index.repeated()] == whole


def test_matching_statistics_against_the_suffix_array():
    rng = random.Random(7)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 20))) for _ in range(3)]
        texts = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5))]
        joined = b"\0".join(texts) + b"\0"
        above, shared = run_index.RunIndex(texts, 8, [0] * len(texts)).matching_statistics(np.arange(len(joined)))
        order = sorted(range(len(joined)), key=lambda i: joined[i:])
        for i, j in zip(order[1:], order, strict=False):
            same = 0
            while max(i, j) + same < len(joined) and joined[i + same] == joined[j + same]:
                same += 1
            assert shared[i] == same and (above[i] == j or not same)


@pytest.mark.parametrize("sampled", [1, 2])
def test_substring_dedup_window_by_window(spark, monkeypatch, sampled):
    """Frequent anchors go window by window, with the same result."""
    line = "a line of about eighty bytes that very many of the documents here have in common"
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("xyz") for _ in range(150))
    rows = [(i, noise() + line + noise()) for i in range(60)]
    rows += [(i + 100, t + line + t) for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        return sorted(map(tuple, substring_dedup.digest_of(substring_dedup.cut(docs)).collect()))

    plain = found()
    monkeypatch.setattr(substring_dedup, "CONTEXTS", 4)
    monkeypatch.setattr(substring_dedup, "SAMPLED", sampled)
    assert len(substring_dedup.frequent_anchors(docs.select("text"), 100))
    assert found() == plain
