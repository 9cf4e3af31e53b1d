import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engrava.llm import near_duplicates, packing, personal, textkernel
from engrava.operators.components import connected_components
from engrava.llm.leakage import align, leaks
from engrava.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from engrava.llm.shared_spans import shared_share, shared_spans


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBİß1_ .\n٣é中😀", max_size=30), min_size=1, max_size=5))
def test_words_are_runs_of_letters_and_digits(texts):
    found = textkernel.Words(texts)
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    every = [w for t in texts for w in words(t)]
    for i, a in enumerate(every):
        for j, b in enumerate(every):
            assert (a == b) == (found.hash[i] == found.hash[j])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60), st.integers(1, 8), st.integers(1, 12))
def test_equal_stretches_have_a_common_anchor(a, b, length, run):
    def chosen(text):
        points, _ = textkernel.code_points([text])
        points = points[:-1]
        at = textkernel.anchors(textkernel.Prefix(points).all(length), run)
        return {text[i : i + length] for i in at}

    need = length + run - 1
    for i in range(len(a) - need + 1):
        if a[i : i + need] in b:
            assert chosen(a) & chosen(b)


def grams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_spans(texts, n):
    held = {}
    for i, t in texts:
        for p in range(len(t or "") - n + 1):
            held.setdefault(t[p : p + n], set()).add(i)
    out = set()
    for i, t in texts:
        at = [p for p in range(len(t or "") - n + 1) if len(held[t[p : p + n]]) > 1]
        for k, p in enumerate(at):
            if k and p - at[k - 1] <= n:
                out.remove((i, start, at[k - 1] + n))
            else:
                start = p
            out.add((i, start, p + n))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_shared_spans_match_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("abcdefgh é😀\n") for _ in range(k))
    common = [letters(rng.randrange(15, 120)) for _ in range(4)]
    texts = [(i, "".join(rng.choice([letters(rng.randrange(30)), rng.choice(common)[rng.randrange(10) :]]) for _ in range(6))) for i in range(30)]
    texts += [(100 + i, "a" * 90) for i in range(3)] + [(200, None), (201, ""), (202, "a"), (203, letters(20_000) + common[0])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts] + [(None, common[0], "x", "y"), (0, texts[0][1], "x", "y")], "doc_id long, text string, hash string, pos string")
    mine = {tuple(r) for r in shared_spans(df.repartition(6), 20).collect()}
    assert mine == brute_spans(texts, 20)


def test_shared_share_and_empty(spark):
    text = "0123456789" * 40
    df = spark.createDataFrame([(1, text), (2, "zz" + text), (3, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.n_chars, r.n_spans, r.shared_chars) for r in shared_share(df).collect()} == {(1, 400, 1, 400), (2, 402, 1, 400)}
    assert shared_spans(df.filter("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, 0)


def test_leaks_find_exact_and_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(30))) for i in range(12)]
    docs = []
    for d in range(80):
        body = some(60)
        if d % 3 == 0:
            item = words(items[d % 12][1])
            n = rng.randrange(8, 20)
            body[10:10] = item[rng.randrange(10) :][:n]
        docs.append((d, "... ".join(body).upper()))
    edited = words(items[0][1])
    for i in range(0, 30, 9):
        edited[i] = "changed"
    docs += [(900, " ".join(edited)), (901, None), (902, ""), (903, "one"), (904, " ".join(some(5000)) + " " + items[1][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, gram string").repartition(5)
    it = spark.createDataFrame([*items, (50, None), (51, "short"), (None, items[0][1])], "item_id long, text string")
    found = leaks(df, it, block_grams=64)  # several blocks of items
    rows = found.collect()
    held = [(i, grams(x, 12)) for i, x in items]
    truth = {(d, i) for d, t in docs for g in [grams(t, 12)] for i, x in held if g & x}
    assert {(r.doc_id, r.item_id) for r in rows if r.longest_run >= 12} == truth and (904, 1) in truth
    copy = [r for r in rows if (r.doc_id, r.item_id) == (900, 0)]
    assert copy and copy[0].longest_run < 12 and copy[0].score >= 0.6 * 2 * 30
    assert leaks(df.filter("doc_id < 0"), it).count() == 0
    assert leaks(df, it.filter("item_id < 0")).count() == 0


@pytest.mark.parametrize("block_grams", [1 << 20, 40])
def test_edited_copies_are_found_beside_exact_ones(spark, block_grams):
    rng = random.Random(9)
    some = lambda n: [rng.choice([f"w{i}" for i in range(60)]) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([30, 24, 41, 13, 5, 2, 1])]
    docs = [(100 + i, some(20) + x + some(20)) for i, x in items]
    for i, x in items:
        for t in range(12):
            y = list(x)
            for _ in range(rng.randrange(1, 2 + len(x) // 4)):
                at = rng.randrange(len(y))
                y[at : at + rng.randrange(2)] = [f"new{rng.randrange(9)}"]
            docs.append((1000 * (i + 1) + t, some(40) + y + some(rng.randrange(60))))
    df = spark.createDataFrame([(d, " ".join(y)) for d, y in docs], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    code = lambda x: np.array([hash(w) & (2**63 - 1) for w in x], np.uint64)
    truth = {}
    for i, x in items:
        best, run = align([code(y) for _, y in docs], [code(x)] * len(docs))
        truth |= {(d, i): (s, r) for (d, _), s, r in zip(docs, best.tolist(), run.tolist(), strict=True) if s >= 0.6 * 2 * len(x)}
    found = {(r.doc_id, r.item_id): (r.score, r.longest_run) for r in leaks(df, it, block_grams=block_grams).collect()}
    assert {p: found.get(p) for p in truth} == truth
    assert sum(r < 12 for _, r in truth.values()) > 60
    with pytest.raises(ValueError):
        leaks(df, it, share=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_alignment_matches_the_plain_recurrence(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    run = np.zeros_like(h)
    for i in range(len(a)):
        for j in range(len(b)):
            same = a[i] == b[j]
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if same else -2), h[i, j + 1] - 2, h[i + 1, j] - 2)
            run[i + 1, j + 1] = run[i, j] + 1 if same else 0
    best, longest = align([np.array(a, np.uint64)], [np.array(b, np.uint64)])
    assert (best[0], longest[0]) == (h.max(), run.max())


def brute_pairs(texts, similarity, n):
    sets = {i: grams(t, n) for i, t in texts}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("seed", "similarity", "n", "hot"), [(0, 0.6, 3, 4096), (1, 0.8, 5, 4096), (2, 0.6, 3, 4)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, seed, similarity, n, hot):
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    texts = []
    for i in range(150):
        if texts and rng.random() < 0.6:
            w = words(rng.choice(texts)[1])
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - 3)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))]
        texts.append((i, " ".join(w)))
    texts += [(500 + i, "same text in very many copies of it here") for i in range(30)] + [(600, None), (601, ""), (602, "one"), (603, " ".join(vocabulary * 300))]
    rows = texts + [(None, texts[0][1]), (0, texts[0][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "id long, text string, key string").repartition(5)
    got = near_duplicate_pairs(df, similarity, n).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_pairs(texts, similarity, n)
    groups = {r.id: r for r in near_duplicate_groups(df, similarity, n).collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(texts, similarity, n):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r.group_id for i, r in groups.items()} == {i: root(i) for i in groups}
    assert groups[500].n_copies == 30 and {groups[500 + i].class_id for i in range(30)} == {500}


def test_an_id_with_two_texts_stands_for_one_of_them(spark):
    a, b = "one two three four five six seven", "red green blue white black grey pink"
    texts = [(1, a), (2, a + " eight"), (3, b), (4, b + " brown"), (5, b)]
    df = spark.createDataFrame([*texts, (1, b)], "id long, text string")
    got = {tuple(r) for r in near_duplicate_pairs(df, 0.6, 3).collect()}
    assert got in (brute_pairs(texts, 0.6, 3), brute_pairs([(1, b), *texts[1:]], 0.6, 3))


def test_no_near_duplicates_in_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert near_duplicate_pairs(empty, 0.6, 3).count() == 0 and near_duplicate_groups(empty).count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5001] == 5000 and len(got) == 263
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_packing_keeps_every_token_once_and_wastes_little(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 900)))) for i in range(300)]
    docs += [(900, "word " * 9000), (901, None), (902, ""), (903, "\n\n"), (None, "text")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, fill int").repartition(4)
    placed = packing.pack(df, 2048).collect()
    encode = packing.tokenizer(*packing.default_vocabulary()).encode_ordinary
    size = {i: len(encode(t)) for i, t in docs if i is not None and t}
    got = {}
    for r in placed:
        got.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    for i, n in size.items():
        parts = sorted(got.pop(i))
        assert parts[0][0] == 0 and sum(k for _, k in parts) == n and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))
        assert n > 2048 or len(parts) == 1
    assert not got
    full = packing.containers(df, 2048).collect()
    assert max(r.fill for r in full) <= 2048 and len(full) <= -(-sum(size.values()) // 2048) * 1.1 + 1
    assert packing.containers(df.filter("doc_id < 0")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60))
def test_packer_follows_the_sum_of_squares(sizes):
    packer, counts, fill = packing.SquarePacker(12), [0] * 13, {}
    for s in sizes:
        at = packer.place(s)
        level = fill.get(at, 0)
        fill[at] = level + s
        cost = lambda h: (0 if h == 0 else (counts[h] - 1) ** 2 - counts[h] ** 2) + (0 if h + s == 12 else (counts[h + s] + 1) ** 2 - counts[h + s] ** 2)  # noqa: B023,E731
        assert cost(level) == min(cost(h) for h in range(13 - s) if h == 0 or counts[h])
        if level:
            counts[level] -= 1
        if level + s < 12:
            counts[level + s] += 1
    assert sum(fill.values()) == sum(sizes) and max(fill.values()) <= 12 and packer.opened == len(fill)


NAMES = personal.Names([("  Raenua", "BODAUHE "), ("Leller", "Gallless"), (None, None)])
CASES = [
    ("Send the report to raenua.bodauhe [at] ops-team.invalid.", {("email", "raenua.bodauhe [at] ops-team.invalid")}),
    ("Contact: <Tenriel.Mallko (at) dept (dot) mail (dot) test> now", {("email", "Tenriel.Mallko (at) dept (dot) mail (dot) test")}),
    ("mailto:a.b@mail.example is wired", {("email", "a.b@mail.example")}),
    ("Clone git@forge.example:a/b.git, pin lib@1.2.3 and @x/token@6.4.8, login root@host", set()),
    ("tel +44 20 7946 0171, mornings. Call 1-303-555-0109 ext. 326 if", {("phone", "+44 20 7946 0171"), ("phone", "1-303-555-0109 ext. 326")}),
    ("Reached them at (202) 555-0197 or 07700 900228", {("phone", "(202) 555-0197"), ("phone", "07700 900228")}),
    ("Sum over 384 512 3072 and port range 2122-4275, build 2024.183.3034", set()),
    ("passport no. 85.690.070-O, SSN 666 52 8610, tax id ZZ 990 8108", {("identity", "85.690.070-O"), ("identity", "666 52 8610"), ("identity", "ZZ 990 8108")}),
    ("Layer shape is 320-29-2048 for the head; run 62126827-9859-3820-9176", set()),
    ("billing address: 402 Hihe Lane\nDolahaven 04299 and so", {("address", "402 Hihe Lane\nDolahaven 04299")}),
    ("Ship to C/ Cornwa, 930, 3.º B, 00358 Benlurhaven. Deliver to Flat 5, 259 Fernwern Close, Wurbefield", {("address", "C/ Cornwa, 930, 3.º B, 00358 Benlurhaven"), ("address", "Flat 5, 259 Fernwern Close, Wurbefield")}),
    ("slot 148 at Main Path 22", set()),
    ("owner is Vualual B. Dackgua, backup is on leave. Ask bodauhe, raenua before you restart", {("name", "Vualual B. Dackgua"), ("name", "bodauhe, raenua")}),
    ("Leller Gallless wrote it; L. Gallless / 202 555 0117", {("name", "Leller Gallless"), ("name", "L. Gallless"), ("phone", "202 555 0117")}),
    ("agent-raenua claims the gallless scan", set()),
    ("forward this to Maria Gonzalez. I met John Smith yesterday", {("name", "Maria Gonzalez"), ("name", "John Smith")}),
    ("Ship to 12 Rue de Rivoli, Paris 75001 please, or 10 Downing Street, London SW1A 2AA", {("address", "12 Rue de Rivoli, Paris 75001"), ("address", "10 Downing Street, London SW1A 2AA")}),
    ("call 06 12 34 56 78 now; SSN-like 078051120 it is", {("phone", "06 12 34 56 78"), ("identity", "078051120")}),
    ("ask Kafka Broker before you, as user Payment Gateway could not", set()),
    ("order 912345678 of part ZZ1234567 took 3112 ms per frame", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_findings(text, wanted):
    assert {(k, text[a:b]) for a, b, k in personal.find(text, NAMES)} == wanted


@given(st.text(alphabet="0123456789", min_size=2, max_size=20))
def test_feistel_is_a_permutation(digits):
    key = b"0123456789abcdef"
    out = personal.permute_digits(digits, key)
    assert len(out) == len(digits) and out.isdigit() and personal.restore_digits(out, key) == digits


KEY = b"0123456789abcdef"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789", min_size=9, max_size=9))
def test_identity_pseudonyms_stay_valid_or_invalid(digits):
    out = personal._identity(digits, KEY)
    assert personal.valid_ssn(out) == personal.valid_ssn(digits)
    dashed = f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"
    assert personal._identity(dashed, KEY).replace("-", "") == out  # one number, one pseudonym
    for letter in "TRWZ":
        new = personal._identity(digits[:8] + letter, KEY)
        assert (new[-1] == personal.dni_letter(new[:8])) == (letter == personal.dni_letter(digits[:8]))
    assert re.fullmatch(r"[A-Z]{2}\d{7}", personal._identity("AB" + digits[:7], KEY))


def test_pseudonyms_do_not_collide():
    assert len({personal._identity(f"{i:08d}{personal.dni_letter(f'{i:08d}')}", KEY) for i in range(3000)}) == 3000
    assert len({personal._phone(f"+1 202 555 {i:04d}", KEY) for i in range(3000)}) == 3000
    assert len({personal._date(f"{1900 + i % 200}-{1 + i % 12:02d}-{1 + i % 28:02d}", KEY) for i in range(4200)}) == len({(i % 200, i % 12, i % 28) for i in range(4200)})
    assert personal._phone("2025550101", KEY) != personal._identity("202555010", KEY)  # kinds are permuted apart


@pytest.mark.parametrize("same", [
    ["+44 1632 960668", "0044 1632 960668", "01632 960668", "+441632960668", "+44 (0)1632 960668"],
    ["+1 202 555 0101", "202-555-0101", "(202) 555-0101", "1-202-555-0101"],
    ["+33 6 12 34 56 78", "+33612345678", "0033 612 345 678"],
])
def test_phone_numbers_are_one_however_written(same):
    parts = {personal.phone_parts(personal._phone(v, KEY))[:2] for v in same}
    assert len(parts) == 1 and parts != {personal.phone_parts(same[0])[:2]} and parts.pop()[0] == personal.phone_parts(same[0])[0]


def test_dates_of_birth_are_one_however_written():
    texts = ["born 1980-05-12 in", "DOB: 12/05/1980", "born on May 12, 1980", "nacida el 12.05.1980", "date of birth 12 May 1980"]
    days = {personal.read_date(re.search(r"\[DATE:(.*)\]", personal.redact(t, NAMES, KEY)[0]).group(1)) for t in texts}
    assert len(days) == 1 and None not in days and personal.redact("released 1980-05-12", NAMES, KEY)[1] == 0


#: Sentences of other make than the tables' texts, with what must be found in them; none served to write the rules.
HELD_OUT = [
    ("Could you send it to Laura Bennett before Friday?", {("name", "Laura Bennett")}),
    ("Interview with Tomás Herrera went well.", {("name", "Tomás Herrera")}),
    ("Dear Ms. Olivia Turner, your card arrived.", {("name", "Olivia Turner")}),
    ("You can write to j.doe+billing@mail.company.co.uk or call (415) 555-2671.", {("email", "j.doe+billing@mail.company.co.uk"), ("phone", "(415) 555-2671")}),
    ("Fax: +49 30 901820; her passport number CD7654321 expires soon", {("phone", "+49 30 901820"), ("identity", "CD7654321")}),
    ("We moved to 221 Baker Street, London NW1 6XE last year", {("address", "221 Baker Street, London NW1 6XE")}),
    ("His DNI is 12345678Z and lives at Calle Mayor 12, 28013 Madrid", {("identity", "12345678Z"), ("address", "Calle Mayor 12, 28013 Madrid")}),
    ("Approved by Henry Cole, see build 4.12.9 and commit 1234567", {("name", "Henry Cole")}),
    ("Reserve seats for 1500 guests at 20:30, budget 12 500 000 in total", set()),
    ("The Data Platform team met Order Service owners about queue 5551234", set()),
    ("Invoice 2023-11-05 for 3 x 120.50 was paid", set()),
    ("Hauptstraße 5, 10115 Berlin is closed; ask for room 12", {("address", "Hauptstraße 5, 10115 Berlin")}),
]


def test_held_out_sentences():
    wanted = [(i, *w) for i, (_, ws) in enumerate(HELD_OUT) for w in ws]
    got = [(i, k, t[a:b]) for i, (t, _) in enumerate(HELD_OUT) for a, b, k in personal.find(t, personal.Names([]))]
    both = len(set(wanted) & set(got))
    assert both >= 0.85 * len(wanted) and both >= 0.85 * len(got), (set(wanted) ^ set(got))


def test_more_names_than_a_block(spark, monkeypatch):
    given, family = ["Anna", "Bela", "Cato", "Dora", "Emil"], ["Abbsen", "Bockel", "Crantz", "Dorfer"]
    people = spark.createDataFrame([(g, f) for g, f in zip(given * 4, family * 5, strict=True)], "given_name string, family_name string")
    texts = [f"then {g} {f} and {g} B. {f} came, {f}, {g} too" for g in given for f in family] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    whole = {tuple(r) for r in personal.find_personal(df, people).collect()}
    redacted = {tuple(r) for r in personal.redact_personal(df, people, KEY).collect()}
    monkeypatch.setattr(personal, "NAME_BLOCK", 2)
    assert {tuple(r) for r in personal.find_personal(df, people).collect()} == whole and len(whole) == 60
    assert {tuple(r) for r in personal.redact_personal(df, people, KEY).collect()} == redacted


def test_redaction_links_equal_values_and_keeps_the_rest(spark):
    rows = [(1, "tel 0044 1632 960668, mornings"), (2, "Call 0044 1632 960668 or a@b.example!"), (3, None), (4, ""), (5, "nothing " * 20_000)]
    people = spark.createDataFrame([("Raenua", "Bodauhe", 1)], "given_name string, family_name string, id int")
    df = spark.createDataFrame([(*r, 0) for r in rows], "seq long, text string, n_found int")
    got = {r.id: r.text for r in personal.redact_personal(df, people, b"k" * 16).collect()}
    token = re.search(r"\[PHONE:0044 [\d ]+\]", got[1]).group()
    assert token in got[2] and "960668" not in got[1] + got[2] and "a@b.example" not in got[2] and got[2].endswith("]!")
    assert got[1] == f"tel {token}, mornings" and got[3] is None and got[4] == "" and got[5] == rows[4][1]
    found = personal.find_personal(df.union(df), people).collect()
    assert len(found) == 3
    assert personal.find_personal(df.filter(F.lit(False)), people.filter("id > 5")).count() == 0
