"""Each operator against a plain restatement, on a table with every awkward kind of row, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leasegrain.llm import decontamination, exact_index, langid, licenses, mixing, sharding, simhash, substrings, token_files, toxicity
from leasegrain.llm.common import components
from leasegrain.llm.queries import tokenizer_path
from tests.llm.conftest import prose


def test_shards_hold_equal_rows_and_the_mixture(docs, rows, none):
    got = sharding.interleave(docs, 4, bucket_rows=10).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert sorted(per) == [0, 1, 2, 3]
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for part in per.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        hot = sum(r.source == "hot" for r in part)
        assert abs(hot - sum(r[3] == "hot" for r in rows) / 4) <= 2
    again = sharding.interleave(docs.repartition(5), 4, bucket_rows=1000).select("doc_id", "shard", "slot").collect()
    key = lambda x: sorted((r.doc_id or -1, r.shard, r.slot) for r in x)
    assert key(again) == key(got)
    assert sharding.interleave(none, 4).count() == 0


def test_encoder_finds_known_pieces_in_arrow():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path(), known=40)
    texts = ["one two two", "two", "", None, " odd  one", "two one\nthree,", "Éa Straße x <|endoftext|> x", "three three"]
    for batch in (texts, texts[::-1], [f"{t} {k} more" for k, t in enumerate(texts * 9)], texts, ["", None], [" a"], []):
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in batch]
        lengths, ids = encoder(pa.array(batch, pa.string()), 7)
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        plain, ids = encoder(pa.array(batch, pa.string()))
        assert plain.tolist() == [len(x) - 1 for x in want] and ids.tolist() == [i for x in want for i in x[:-1]]
        assert isinstance(encoder.known, pa.Array) and len(encoder.known) == len(encoder.known.unique())


def test_tokens_round_trip(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), segment=500)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    ids = {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path / "t")).collect()}
    assert ids[131] == [*library.encode("ab " * 4000).ids, 0]
    token_files.write_tokens(none, str(tmp_path / "n"), tokenizer_path())
    assert token_files.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_any_stretch_decodes_alone_and_damage_is_found(monkeypatch):
    monkeypatch.setattr(token_files, "CHECK", 1024)
    ids = np.random.default_rng(1).zipf(1.3, 5000).clip(0, 50_000).astype(np.uint32)
    data = token_files.pack_segment([1], np.array([len(ids)]), ids)
    segment = token_files.Segment(data)
    first, n = segment.checks[3][:2]
    assert (segment.stretch(3) == ids[first : first + n]).all()
    with pytest.raises(ValueError):
        token_files.Segment(data[:-900] + bytes(x ^ 255 for x in data[-900:-800]) + data[-800:]).ids()


def simhash_plainly(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_components_are_those_of_brute_force(docs, rows, none):
    prints = [simhash_plainly(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    want = Counter((r[0], p, least[g]) for r, p, g in zip(rows, prints, group))
    got = simhash.near_components(docs).collect()
    assert Counter((r.doc_id, r.print % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_components(none).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert 100 in kept and 101 not in kept and kept.count(130) == 1


def test_links_are_complete_for_any_allocation(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for b in base for _ in range(12)}
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    joint = simhash.moments(table)
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4}
    plans = [simhash.plan(joint, len(prints)), simhash.plan(joint, 10**8), [(list(range(0, 20)), 1), (list(range(20, 64)), 2)]]
    for parts in plans:
        got = simhash.links(table, parts).collect()
        assert {frozenset((x.a % (1 << 64), x.b % (1 << 64))) for x in got} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(41), 100, 101, 200]], "id long")
    got = {r.id: r.component for r in components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}


def test_exact_groups(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[(r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_index.exact_groups(docs).collect())) == want
    assert exact_index.exact_groups(none).count() == 0


def test_index_takes_and_gives_up_texts(spark, tmp_path):
    t = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    index = exact_index.LiveIndex.create(t((1, "a"), (2, "b")), str(tmp_path / "i")).insert(t((1, "a"), (2, "b"), (3, "a")))
    index = index.insert(t((9, "b"), (4, "c"))).delete(t((0, "a"), (0, "never there")))
    live = {r.text: (r.keep_id, r.group_size) for r in index.content().collect()}
    assert live == {"b": (9, 2), "c": (4, 1)}
    assert {r.text for r in index.insert(t((5, "a"))).content().collect()} == {"a", "b", "c"}


def test_cuckoo_filter_grows_and_forgets():
    bucket = exact_index.Bucket()
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, d in enumerate(keys):
        bucket.insert(d, str(k), k, 1)
    assert all(d in bucket.filter for d in keys) and bucket.filter.count == 3000
    for k, d in enumerate(keys[:1500]):
        bucket.delete(d, str(k))
    again = exact_index.CuckooFilter.unpack(bucket.filter.pack())
    assert all(d in again for d in keys[1500:]) and sum(d in again for d in keys[:1500]) < 30


def test_items_with_other_numbers_and_names_are_found(spark, none):
    item = "A train leaves the old station with 120 people and travels to Boston at 60 km before Maria counts 120 tickets again."
    other = item.replace("120", "77").replace("Boston", "Denver").replace("60 km", "45 miles").replace("Maria", "Joan")
    broken = item.replace("120 people", "77 people").replace("120 tickets", "78 tickets")
    texts = ["some lead " + item + " and a tail", "so " + other, "we " + broken, "nothing of it at all stands here", None, "", "x " * 9000 + item]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(6, texts[6], 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    got = {r.doc_id: r.slots_changed for r in decontamination.matches(docs, items).collect()}
    assert got == {0: False, 1: True, 6: False}
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [2, 3, 4, 5]
    assert decontamination.matches(none.select("doc_id", "text"), items).count() == 0


def test_toxic_words_are_learnt(spark, none):
    clean = ["plain words about a garden " + str(k) for k in range(300)]
    bad = ["you idiot and moron go away zornig" + "abcdefgh"[k % 8] + " number " + str(k) for k in range(100)]
    rows = [(k, t, int(k >= 300), 0.1) for k, t in enumerate(clean + bad)] + [(900, None, None, 0.1), (901, "", None, 0.1)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    got = {r.doc_id: r for r in toxicity.judge(data.drop("toxic"), data.select("doc_id", "toxic")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    right = [got[k].predicted == (k >= 300) for k in range(400) if got[k].held_out]
    assert sum(right) / len(right) > 0.95 and got[900].predicted == got[901].predicted == 0
    assert toxicity.judge(none, none.selectExpr("doc_id", "1 toxic")).count() == 0


def test_features_of_stretches_are_those_of_the_whole(monkeypatch):
    text = " ".join(f"word{chr(97 + k % 26)}x" for k in range(500))
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert set(toxicity.features(text).tolist()) == whole
    assert toxicity.place_of("wordax") in whole


def repeats_plainly(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_shared_passages_of_fifty_words_are_marked(spark, docs, rows, none):
    def plainly(texts):
        passages = []
        for text in texts:
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
            passages.append({tuple(w[k : k + 50]) for k in range(len(w) - 49)})
        count = Counter(p for one in passages for p in one)
        return [any(count[p] > 1 for p in one) for one in passages]

    short = " ".join(f"w{k}" for k in range(50))  # fewer than 400 bytes
    texts = [f"{prose(700, 80)} {short} {prose(701, 20)}", f"x {short.upper()}\n{prose(702, 30)}", prose(703, 40) + " " + short[: short.rindex(" ")]]
    texts += [prose(704, 60) + " and " + prose(704, 60), short[3:], prose(705, 49), prose(705, 49), prose(706, 50), prose(706, 50), None, "", None]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), passages=True).collect()
    assert plainly(texts) == [True, True, False, False, False, False, False, True, True, False, False, False]
    assert {r.doc_id: r.shares_passage for r in got} == dict(enumerate(plainly(texts)))
    assert all(r.n_removed == 0 for r in got if r.doc_id in (0, 1))
    want = Counter(zip([r[0] for r in rows], plainly([r[1] for r in rows])))
    assert Counter((r.doc_id, r.shares_passage) for r in substrings.remove_repeats(docs, passages=True).collect()) == want
    assert substrings.remove_repeats(none, passages=True).count() == 0


def test_repeats_are_those_of_brute_force(docs, rows, none):
    want = Counter((r[0], *x) for r, x in zip(rows, repeats_plainly([(r[1] or "").encode() for r in rows], substrings.LENGTH)))
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == want
    assert sum(n for x, n in want.items() if x[2]) > 8
    assert substrings.remove_repeats(none).count() == 0


def test_language_codes(spark, none):
    words = {"aa": "kilo mega tera piko", "bb": "sous avec chez dans", "cc": "und oder aber doch"}
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words[lang].split()) for _ in range(15)), lang, 0.1) for k, lang in enumerate(list(words) * 60)]
    rows += [(900, None, "aa", 0.1), (901, "12 34 !!", "aa", 0.1), (902, "und oder " * 3000, None, 0.1)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(data).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == lang for k, _, lang, _ in rows if k < 900)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "cc"
    assert langid.identify(none).count() == 0


LICENSED = [
    None,
    "",
    "Licensed under the Apache License, Version 2.0. The GNU General Public License and gnu GENERAL public license",
    "CC BY-NC 4.0 cc_by MIT\nLicense",
    "acc by emit license éapache license apache licenses",
    "SPDX-License-Identifier: GPL-3.0-only",
    "w " * 5000 + "released under the MIT license",
]


@pytest.mark.parametrize("text", LICENSED)
def test_base_phrases_are_counted_word_by_word(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p]
    got = licenses.scan(text)
    assert got[:2] == (len(words), len(places))
    assert got[2:4] == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert got[4] == ",".join(sorted({x for _, x in places}))
    assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_detections_within_others_are_suppressed(docs, rows, none):
    assert licenses.scan(LICENSED[2].split(". The")[0])[5] == "apache,apache-2.0"
    assert licenses.scan("under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc-4.0"
    assert licenses.scan(LICENSED[5])[5] == "gpl-3"
    assert len(licenses.RULES) > 200
    assert licenses.with_licenses(docs).count() == len(rows) and licenses.with_licenses(none).count() == 0


def samples(parsed):
    """A text for each alternative of a parsed pattern, and with and without each optional part."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else {"CATEGORY_DIGIT": "3", "CATEGORY_SPACE": " "}.get(str(a), "x") for o, a in arg[:2]]
            more = more if str(arg[0][0]) == "LITERAL" else more[:1]
        elif op == "BRANCH":
            more = [x for branch in arg[1] for x in samples(branch)]
        elif op == "SUBPATTERN":
            more = samples(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            few, many, inner = arg
            more = [x * max(few, 1) for x in samples(inner)] + ([""] if few == 0 else [])
        elif op == "ANY":
            more = ["x y " * 60 + "x"]
        else:
            assert op in ("ASSERT", "ASSERT_NOT", "AT"), op
            more = [""]
        out = [a + b for a in out for b in more][:400]
    return out


def test_rules_are_tried_on_every_text_they_match():
    parser, tried = re._parser, 0
    for rule in licenses.RULES:
        if b"://" in rule.keywords:
            continue
        for text in samples(parser.parse(rule.pattern.pattern.decode())):
            if rule.pattern.fullmatch(text.encode()):
                tried += 1
                low = licenses.SPACES.sub(b" ", text.encode())
                assert any(k in low for k in rule.keywords) and licenses.GATE.search(low), text
                wrapped = licenses.scan("w " + re.sub(r"\s+", "\n  ", text) + " w")
                assert wrapped == licenses.scan(f"w {text} w") and wrapped[5], text
    assert tried > 500


def test_alternatives_without_the_short_name_get_a_label():
    name = "Creative Commons Attribution-NonCommercial-"
    for text, label in [
        (name + "ShareAlike", "cc-by-nc-sa"),
        (name + "NoDerivatives", "cc-by-nc-nd"),
        ("Creative Commons Zero", "cc0"),
        ("zero clause BSD", "0bsd"),
        ("the GNU General\nPublic License", "gpl"),
        ("placed in the public\ndomain", "public-domain"),
        ("All\n rights  reserved", "all-rights-reserved"),
        (f"Neither the name of {'the holder or ' * 20}its contributors may be used to endorse or promote products", "bsd-3"),
    ]:
        assert label in licenses.scan(text)[5].split(","), text


def test_mixture_comes_near_its_targets(docs, rows, none):
    got = mixing.mix(docs, bucket_rows=7).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(r.source_size == size[r.source] for r in got)
    assert sum(target.values()) == pytest.approx(sum(size.values())) or all(target[s] == 3 * size[s] for s in target)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 10 for s in target)
    again = mixing.mix(docs.repartition(6), bucket_rows=1000).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in made.collect())
    assert words == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_seats_go_to_the_highest_quotients():
    r = random.Random(6)
    for _ in range(30):
        votes = {f"p{k}": r.random() * 10 ** r.randrange(4) for k in range(r.randrange(1, 9))}
        seats = r.randrange(60)
        quotients = sorted(((v / (2 * k + 1), s) for s, v in votes.items() for k in range(seats)), reverse=True)[:seats]
        want = Counter(s for _, s in quotients)
        assert mixing.apportion(votes, seats) == {s: want[s] for s in votes}


def test_targets_stop_at_three_times_the_source():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 500)])
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(1510)


def test_a_source_of_a_millionth_comes_near_its_target():
    sizes = [(f"s{k:02}", 300_000_000) for k in range(19)] + [("tiny", 5_000)]
    for row in mixing.plan(sizes, 11, 16):
        s, size, target, block, blocks, passes, extra, part, a, c = *row[:5], *row[6:8], row[11], *row[8:10]
        ends = [(((a * j + c) % blocks), min(size, (j + 1) * block) - j * block) for j in range(blocks)]
        taken = passes * size + sum(n if rank < extra else min(n, part) if rank == extra else 0 for rank, n in ends)
        assert abs(taken - target) <= 0.002 * target and taken <= 3 * size, s


def test_a_tiny_source_stays_in_the_mixture(spark):
    rows = [(k, f"s{k % 3}", prose(k, 400)) for k in range(90)] + [(900 + k, "tiny", prose(k, 3)) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r for r in mixing.mix(docs, bucket_rows=20, blocks_per_source=3).collect()]
    for s in ("s0", "s1", "s2", "tiny"):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01), s
        assert all(0 <= a < b <= r.size for r in mine for a, b in r.picked)


def test_an_item_after_a_number_keeps_its_slots(spark):
    twelve = "12 boys and 12 girls share the apples of the old garden"
    docs = spark.createDataFrame([(0, "see exercise 7. " + twelve), (1, "exercise 8 " + twelve.replace("12", "31") + " at home")], "doc_id long, text string")
    got = {r.doc_id: r.slots_changed for r in decontamination.matches(docs, spark.createDataFrame([(1, twelve)], "item_id long, text string")).collect()}
    assert got == {0: False, 1: True}


def test_verbatim_items_are_found_whatever_surrounds_them(spark):
    twelve = "12 boys and 12 girls share the apples of the old garden"
    caps = "Aunt Maria Saw Boston And Denver With Old Uncle Henry Today"
    plain = "the small dog of the farmer ran home over 30 green hills to sleep"
    dates = "On Monday 4 Maria 7 Joan 9 Henry 11 Paul 13"
    items = [(1, twelve), (2, "Solve 3x = 12"), (3, "What is 48 * 7 / 12 + 3?"), (4, caps), (5, plain), (6, dates)]
    texts = [
        "see exercise 7. " + twelve + " and more",
        "we had to solve 3x = 12 at once",
        "now what is 48 * 7 / 12 + 3 said he",
        "it was so that yesterday in the end " + caps + " and nobody in the house of the old man knew of any of it at all",
        ("ALL IS IN CAPITALS. " + plain + ". THE END").upper(),
        "exercise 8 " + twelve.replace("12", "31") + " at home",
        "what is 48 * 7 / 12 + 4 and solve 3x = 13",
        "lines of " + dates,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.slots_changed for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1): False, (1, 2): False, (2, 3): False, (3, 4): False, (4, 5): False, (5, 1): True, (7, 6): False}
