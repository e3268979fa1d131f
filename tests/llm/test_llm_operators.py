"""Each operator against a plainer computation, and on awkward tables: nulls, empty and long texts, repeated rows, clashing names."""
from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netweft.llm import batches, byte_bpe, decontamination, jpeg, language, media, minhash, pii, quality, repeats, shingles, token_files, warc
from netweft.plans.scratch import new_folder
from netweft.plans.scratch import stored as plans_stored

PROSE = "the cat sat on the mat and the dog lay by the door of the old house while it was raining in the town "
LONG = " ".join(f"word{i % 977} and thing{i % 1013}" for i in range(20_000))
TEXTS = [
    None, "", "   \n ", "one", "Naïve café 日本語 🙂 x@y.org +1 (555) 123-4567", PROSE * 12, PROSE * 12, PROSE.upper() * 3,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 30, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 30 + "tail", LONG, "x" * 5000, "\x00\x01 odd\tspaces　here\x1c end",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every sort of text, a null id, one row twice, and columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id " * 9), (5, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "n", "digest", "spans", "kept", "found", "votes", "rep", "family", "ids", "payload", "url"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# --- personal data


def plain_base(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits(m[0])) <= 19 and pii.luhn(d)]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_pii_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "b_", "-", "1", "25", "256", "0007", "+", " ", "(", ")", "é", "4111 1111 1111 1111", "10.0.0.1", "x@y.z"]) for _ in range(rng.randint(0, 25)))
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert got == plain_base(text), text


def test_pii_checksums_context_and_redaction():
    text = "Bank account GB82 WEST 1234 5698 7654 32, social security 123-45-6789." + " and so on" * 9 + " order 123-45-6788."
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33")]
    assert pii.redacted("mail a@b.cd now, a@b.cd") == "mail [EMAIL] now, [EMAIL]"
    assert pii.redacted(None) is None and pii.redacted("") == ""


def test_pii_account_numbers_end_at_their_countrys_length():
    for iban in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "NO9386011117947"):
        for after in ("", " A Juan", " 2024", " BIC OPSK", ", 2024", " 7"):
            text = f"pay ID12 {iban}{after}"
            assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == [iban], text
            assert pii.redacted(text).startswith("pay ID12 [IBAN]")
    assert not [s for s in pii.find_spans("ES9121000418450200051333 A Juan") if s.kind == "iban"]


def test_pii_secrets_need_letters_digits_entropy_and_a_word_nearby():
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    kinds = lambda text: [(x.kind, text[x.start : x.end]) for x in pii.find_spans(text)]
    assert kinds(f'the token = "{value}" here') == [("secret", value)] and kinds(f"API key: {value}==") == [("secret", value + "==")]
    assert kinds(f"commit {value}") == [] and kinds("the token is " + "ab1" * 20) == [] and kinds("the token is " + "abcdefghij" * 4) == []
    assert kinds("sample token " + value) == [] and pii.redacted(f"token={value}.") == "token=[SECRET]."
    assert kinds("secret " + "z9" * 100_000) == [] and len(kinds("key " + f"{value} " * 1000)) == 1


def plain_em(votes, rounds):
    """Expectation-maximisation document by document."""
    m = len(votes[0])
    post = [0.9 if 3 * v.count("-") < v.count("+") else 0.1 if "-" in v else 0.5 for v in votes]
    for _ in range(rounds):
        good = min(1 - 1e-3, max(1e-3, sum(post) / len(post)))
        chance = [[[1.0, 1.0] for _ in range(m)], [[1.0, 1.0] for _ in range(m)]]
        for v, p in zip(votes, post):
            for j, x in enumerate(v):
                if x != "0":
                    chance[0][j][x == "+"] += 1 - p
                    chance[1][j][x == "+"] += p
        before, post = post, []
        for v in votes:
            a, b = 1 - good, good
            for j, x in enumerate(v):
                if x != "0":
                    a *= chance[0][j][x == "+"] / sum(chance[0][j])
                    b *= chance[1][j][x == "+"] / sum(chance[1][j])
            post.append(b / (a + b))
        if max(abs(x - y) for x, y in zip(before, post)) < 1e-9:
            break
    return post


def test_quality_em_over_patterns_is_that_over_documents():
    rng = random.Random(31)
    votes = []
    for _ in range(400):
        good = rng.random() < 0.7
        v = "".join("0" if rng.random() < 0.3 else "+" if (rng.random() < 0.85) == good else "-" for _ in range(5))
        votes += [v] if v.strip("0") else []
    model = quality.WeakLabels(Counter(votes))
    assert all(abs(model.probability(v) - p) < 1e-6 for v, p in zip(votes, plain_em(votes, 200)))


def test_quality_scorer_steps_are_those_of_logistic_regression():
    rng = np.random.default_rng(32)
    rows, wanted = rng.normal(size=(30, 4)).astype(np.float32), rng.uniform(0, 1, 30)
    w, bias, past, past_bias = [0.0] * 4, 0.0, [1e-6] * 4, 1e-6
    for _ in range(5):
        error = [1 / (1 + np.exp(-(sum(x * y for x, y in zip(r, w)) + bias))) - t for r, t in zip(rows.tolist(), wanted)]
        step = [sum(e * r[k] for e, r in zip(error, rows.tolist())) / 30 + 1e-5 * w[k] for k in range(4)]
        past = [p + s * s for p, s in zip(past, step)]
        w = [x - 0.5 * s / p**0.5 for x, s, p in zip(w, step, past)]
        past_bias += np.mean(error) ** 2
        bias -= 0.5 * np.mean(error) / past_bias**0.5
    got, got_bias = quality.fit_scorer(rows, wanted, rounds=5)
    assert np.allclose(got, w, atol=1e-4) and abs(got_bias - bias) < 1e-4


def test_pii_is_linear_in_awkward_texts():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "9" * 5000 + ".1.1.1"):
        pii.find_spans(text)


def test_pii_on_odd_rows(odd, nothing):
    rows = pii.detect(odd).collect()
    assert sorted((str(r["doc_id"]), [s["kind"] for s in r["spans"]]) for r in rows) == sorted((str(i), [s.kind for s in pii.find_spans(t)]) for i, t in texts_of(odd))
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.detect(nothing).count() == 0 and pii.redact(nothing).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.encoder(byte_bpe.default_ranks(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_the_library_s_ids(bpe, tiktoken_encoding):
    rng = random.Random(2)
    alphabet = ["the", "ing", " ", "  ", "\n", "'s", "é", "日本", "🙂", "123", "\t", "ß", "Ω", "x", "qz", "　", "\x1c", "!!", "ação"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


@pytest.mark.parametrize("held", [3, 1_000_000])
def test_ids_by_parts_are_those_of_whole_texts(tiktoken_encoding, held):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    alphabet = ["the", "Ing", " ", "  ", "\n", "\n\n", "'s", "é", "日本", "123", "\t", "\x85", "\xa0", "\u2003", "\u2028", "\u205f", "\u3000", "\u1680", "‘x’", ",", ".", "!!", "a,b", "7;", "\x1c", "İ", "e\u0301", "\u0301", "|"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    small = byte_bpe.Encoder(byte_bpe.default_ranks(), public_tokenizers.PATTERN, held)
    words, library = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), held), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(0, len(texts), 300):
        some = pa.array(["x", *texts[k : k + 300]]).slice(1)
        coded = small.encode_all(some)
        assert [np.frombuffer(x, "<u4").tolist() for x in coded.to_pylist()] == [tiktoken_encoding.encode_ordinary(x) for x in some.to_pylist()]
        assert small.decode_all(coded).cast(pa.large_string()).to_pylist() == some.to_pylist()
        assert [x.tolist() for x in words.encode(some)] == [library.encode(x, add_special_tokens=False).ids for x in some.to_pylist()]
    with pytest.raises(ValueError):
        small.decode(np.array([1 << 30], "<u4").tobytes())


def test_bpe_by_another_pattern_sees_whole_texts(bpe):
    import tiktoken

    pattern = r"[^!]+|!"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.merges.ranks, special_tokens={})
    e = byte_bpe.Encoder(byte_bpe.default_ranks(), pattern)
    for t in ("two words, a line\nand! more", "", "!!"):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == own.encode_ordinary(t)


def test_samples_are_of_distinct_ids(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) AS key", "cast(id AS string) AS text")
    found = batches.sampled(rows, 50).collect()
    assert len({r["key"] for r in found}) == len(found) == 50
    assert [r["key"] for r in found] == [r["key"] for r in batches.sampled(rows.repartition(7), 50).collect()]
    assert batches.sampled(rows, 5000).count() == rows.select("key").distinct().count()


def test_bpe_states_take_appends_and_edits(bpe):
    rng = random.Random(3)
    made = whole = 0
    for _ in range(500):
        text = "".join(rng.choice(["antidis", "estab", "lish", "ment", "é", "xyz", " "]) for _ in range(30)).encode()
        state = byte_bpe.PrefixState(bpe.merges, text)
        i = rng.randint(0, len(text))
        j, new = rng.randint(i, min(len(text), i + 5)), rng.choice([b"", b"q", b"ing"])
        made += state.replace(i, j, new)
        whole += len(state.piece)
        again = byte_bpe.PrefixState(bpe.merges)
        for k in range(0, len(state.piece), 7):
            again.append(state.piece[k : k + 7])
        assert again.last == state.last
        assert b"".join(bpe.merges.token[t] for t in state.tokens()) == state.piece
    assert made < whole


def test_bpe_on_odd_rows(odd, nothing, tiktoken_encoding):
    rows = byte_bpe.encoded_digests(odd).collect()
    want = [(str(i), len(ids := tiktoken_encoding.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts_of(odd)]
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)
    assert byte_bpe.encoded_digests(nothing).count() == 0


# --- token files


def test_token_files_round_trip(spark, odd, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = new_folder(spark, "tokens")
    parts = token_files.write(odd, folder)
    rows = token_files.read(parts, token_files.ids_crc32).orderBy("start").collect()
    start = 0
    for (i, t), r in zip(sorted(texts_of(odd), key=lambda x: (x[0] is not None, x)), rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["digest"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = parts.where("n_docs > 0").first()["path"]
    reader = token_files.Reader(path)
    row, ids = list(reader)[-1]
    assert reader.document(int(row["doc_id"])).tolist() == token_files.Reader(path).document(int(row["doc_id"])).tolist()
    with pytest.raises(KeyError):
        reader.document(-77)
    assert token_files.read(token_files.write(nothing, new_folder(spark, "tokens")), token_files.ids_crc32).count() == 0


def test_token_files_know_their_dictionary(spark, odd):
    folder = new_folder(spark, "tokens")
    path = token_files.write(odd, folder).first()["path"]
    with open(f"{folder.removeprefix('file://')}/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        token_files.Reader(path)


def test_files_settle_whoever_comes_first(tmp_path):
    from pyarrow import fs

    from netweft.llm.files import settle

    store = fs.LocalFileSystem()
    for k, data in enumerate((b"same", b"same", b"other one")):
        draft = tmp_path / f"draft{k}"
        draft.write_bytes(data)
        if k < 2:
            settle(store, str(draft), str(tmp_path / "final"))
        else:
            with pytest.raises(OSError):
                settle(store, str(draft), str(tmp_path / "final"))
    assert (tmp_path / "final").read_bytes() == b"same" and not (tmp_path / "draft1").exists()


# --- WARC


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 3}.example/\r\nInjected: {i}" if i == 7 else f"http://h{i % 3}.example/{i}", rng.choice(["same", "also", "", None]) if i % 3 else "".join(rng.choices("abcdefgh<>é", k=3000))) for i in range(120)]
    rows += [(None, None, "same"), (3, None, "twice"), (3, None, "twice"), (500, "x", LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("member", F.lit(1)).repartition(4)


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 24])
def test_warc_records_have_one_owner_wherever_files_are_cut(spark, pages, split):
    some = pages if split > 37 else pages.where("page_id < 12")
    rows = some.collect()
    archives = warc.write(some, new_folder(spark, "warc"))
    got = warc.read(archives, split).collect()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(r["page_id"], first.get(r["html"] or "", r["page_id"]))
    want = []
    for r in rows:
        b, f = (r["html"] or "").encode(), first.get(r["html"] or "")
        again = r["page_id"] is not None and f != r["page_id"]
        want.append((str(r["page_id"]), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(f) if again else "None"))
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got) == sorted(want)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert not any("\n" in r["url"] for r in got)


def test_warc_small_payloads_are_all_responses_and_nothing_is_nothing(spark, pages):
    kinds = Counter((r["payload_bytes"] >= 5, r["record_type"]) for r in warc.read(warc.write(pages, new_folder(spark, "warc"), least=5)).collect())
    assert not kinds[False, "revisit"]
    assert warc.read(warc.write(pages.where("false"), new_folder(spark, "warc"))).count() == 0


def test_warc_skips_magic_that_begins_no_record(tmp_path):
    member = warc.record(1, "u", b"body", warc.payload_digest(b"body"), 4)
    junk = b"\x1f\x8b\x08" + bytes(range(50)) + zlib.compress(b"x") + b"\x1f\x8b"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(junk + member + junk + member)
    found = [at for k in range(0, path.stat().st_size, 11) for at, _, _ in warc.records(str(path), k, min(k + 11, path.stat().st_size))]
    assert found == [len(junk), 2 * len(junk) + len(member)]


# --- near-duplicates


def plain_classes(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                top[y] = x
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("block", [3, 1000])
def test_minhash_classes_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng, rows = random.Random(5), []
    for base in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([2, 5, 40, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000, None), (1001, ""), (1002, " \n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == plain_classes(rows, 4, 80)


def test_minhash_on_odd_rows(spark, odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert by[5] == {(5, True)} and by[6] == {(5, False)} and by[8] == {(8, True)} and by[0] == {(0, True)} and by[None] == {(None, True)}
    assert minhash.near_duplicates(nothing).count() == 0
    one = minhash.one_of_each(odd)
    assert one.columns == odd.columns
    assert Counter(r["doc_id"] for r in one.collect())[5] == 1 and not one.where("doc_id = 6").count()
    assert minhash.one_of_each(nothing).count() == 0


def test_minhash_keys_meet_for_all_signatures_within_the_distance():
    form, rng = minhash.Signatures(), np.random.default_rng(6)
    a = rng.integers(0, 1 << form.bits, (300, form.positions)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(form.positions, form.guaranteed, replace=False)] ^= 1
    ka, kb = minhash.chunk_keys(a, form), minhash.chunk_keys(b, form)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


# --- repeats


def plain_spans(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
        out.append((runs, bytes(x for x, c in zip(t, cover) if not c)))
    return out


@pytest.mark.parametrize("most", [1, 1000])
def test_repeats_are_those_of_all_windows(spark, most):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé ") for _ in range(120)) for _ in range(4)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(40, 120)] for _ in range(rng.randint(0, 6))) for _ in range(40)]
    texts += [None, "", "xyz " * 60, "xyz " * 50, base[0], base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.without_repeats(df, length=48, most=most).collect()}
    assert got == dict(enumerate(plain_spans([(t or "").encode() for t in texts], 48)))


@pytest.mark.parametrize("turns", [2, 5, 12])
def test_repeats_of_one_anchor_are_the_same_in_turns(turns):
    rng, core = random.Random(13), b"0123456789XYabcdefghijklmnopqrst"
    draw = lambda: bytes(rng.choice(b"ab") for _ in range(3)) * rng.randint(0, 12)
    parts = [(draw()[:16], draw()[:16]) for _ in range(60)]
    texts = sorted({a + core + b for a, b in parts if len(a) + len(b) >= 16})
    seen = Counter(t[k : k + 48] for t in texts for k in range(len(t) - 47))
    want = [[k for k in range(len(t) - 47) if seen[t[k : k + 48]] > 1] for t in texts]
    assert any(want)
    assert [x.tolist() for x in repeats.repeated_starts(texts, 48)] == want
    anchor = int(repeats._hashes(np.frombuffer(core, np.uint8), 32).view(np.int64)[0])
    rows = [{"anchor": anchor, "stretch": t, "once": True, "turns": turns, "digest": t, "start": 100, "data": t} for t in texts]
    turned = [r for b in repeats._turned(iter([pa.RecordBatch.from_pylist(rows, repeats._CUT)]), 48) for r in b.to_pylist()]
    turned.sort(key=lambda r: (r["turn"], r["symbol"], r["stretch"]))
    assert turns < 12 or len({(r["turn"], r["symbol"]) for r in turned}) > 12
    got = [r for b in repeats._sorted_turns(iter([pa.RecordBatch.from_pylist(turned[:7], repeats._TURNS), pa.RecordBatch.from_pylist(turned[6:], repeats._TURNS)]), 48) for r in b.to_pylist()]
    cover = {t: {i for r in got if r["digest"] == t for i in range(r["start"] - 100, r["end"] - 100)} for t in texts}
    assert cover == {t: {i for k in own for i in range(k, k + 48)} for t, own in zip(texts, want)}


@pytest.mark.parametrize("size", [20, 3000])
def test_repeats_of_large_anchors_are_those_of_all_windows(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "SORTED", size)
    rng = random.Random(14)
    common = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) + common[: rng.randint(300, 700)] + str(k) for k in range(12)] * 2
    df = spark.createDataFrame([(k, t + str(k // 18)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.without_repeats(df, length=48).collect()}
    assert got == dict(enumerate(plain_spans([(t + str(k // 18)).encode() for k, t in enumerate(texts)], 48)))


def test_repeats_hashes_are_the_same_wherever_bytes_stand():
    data = np.frombuffer(random.Random(15).randbytes(300), np.uint8)
    for width in (1, 10, 32, 100):
        h = repeats._hashes(data, width)
        assert len(h) == 301 - width and all(h[k] == repeats._hashes(data[k : k + width], width)[0] for k in range(0, len(h), 17))
    assert not len(repeats._hashes(data[:9], 10))


def test_repeats_of_a_few_bytes_over_and_over_make_few_rows(spark):
    assert [x[1:] for x in repeats.stretches(b"x" * 4_000_000)] == [(0, 1, 4_000_000 - 399)]
    assert len(repeats.stretches(b"start of a line; " * 100_000 + b"ab" * 100_000)) < 40
    texts = ["x" * 3000, "ab" * 900 + "tail", "y" * 399, "y" * 400, "start of a line; " * 60, "z" * 401, "-" + "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.without_repeats(df).collect()}
    assert got == dict(enumerate(plain_spans([t.encode() for t in texts], 400)))


def test_repeats_sorted_suffixes_are_in_order():
    rng = np.random.default_rng(8)
    strings = [rng.integers(0, 3, rng.integers(0, 30)).tolist() for _ in range(12)]
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        string, size, common = repeats.sorted_suffixes(np.array(sum(strings, []), np.int64), np.array([len(s) for s in strings], np.int64), folder)
    suffixes = [tuple(strings[s][len(strings[s]) - n :]) for s, n in zip(string, size)]
    ends = [(-1,)]
    assert [x + ends[0] for x in suffixes] == sorted(x + ends[0] for x in suffixes)
    for k in range(1, len(suffixes)):
        n = 0
        while n < min(len(suffixes[k]), len(suffixes[k - 1])) and suffixes[k][n] == suffixes[k - 1][n]:
            n += 1
        assert common[k] == min(n, repeats._SYMBOLS)


@pytest.mark.parametrize("most", [1, 1000])
def test_repeats_of_words_are_those_of_all_passages(spark, most):
    rng = random.Random(21)
    base = [[rng.choice(["a", "é", "der", "thin", "x" * 50]) + str(rng.randint(0, 9)) for _ in range(40)] for _ in range(4)]
    texts = ["".join(w + rng.choice([" ", "\n", " \t"]) for _ in range(rng.randint(0, 3)) for w in rng.choice(base)[rng.randint(0, 30) :][: rng.randint(5, 14)]) for _ in range(60)]
    texts += [None, "", " \n ", "few words", "one " * 10, "two " * 11, "x" * 900, " ".join(base[0]), " ".join(base[0])]
    seen = Counter(tuple(w[k : k + 10]) for t in texts for w in [(t or "").encode().split()] for k in range(len(w) - 9))
    want = [any(seen[tuple(w[k : k + 10])] > 1 for k in range(len(w) - 9)) for t in texts for w in [(t or "").encode().split()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["passage"] for r in repeats.without_repeats(df, most=most, words=10).collect()}
    assert got == dict(enumerate(want)) and 10 < sum(want) < len(want) - 10
    with pytest.raises(ValueError):
        repeats.without_repeats(df, words=9)


def test_repeats_query_tells_of_passages_of_over_50_words_and_leaves_short_ones(spark, tmp_path):
    draw = lambda n, k: [f"{k}é{i}" for i in range(n)]
    shared, short, long = draw(51, "s"), draw(50, "t"), draw(90, "long")
    texts = [" ".join(draw(20, k) + x + draw(20, k + "z")) for k, x in zip("abcdef", [shared, shared, short, short, long, long])]
    texts += [" ".join(draw(30, "g")), "\n".join(draw(51, "h") + draw(51, "h")), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(repeats.op3_repeats(spark, str(tmp_path)).collect())
    assert [r["repeated"] for r in got] == [True, True, False, False, True, True, False, True, False]
    assert [r["n_removed"] > 0 for r in got] == [k in (4, 5) for k in range(9)]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]


def test_repeats_on_odd_rows(odd, nothing):
    got = sorted((str(r["doc_id"]), [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.without_repeats(odd).collect())
    rows = texts_of(odd)
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_spans([t.encode() for _, t in rows], 400)))
    assert got == want
    assert repeats.without_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(odd, length=45)


# --- media


def test_media_round_trip_and_equal_texts(odd, nothing):
    rows = media.read(media.store(odd)).collect()
    assert len(rows) == odd.count()
    for (i, t), r in zip(sorted(texts_of(odd), key=str), sorted(rows, key=lambda r: str((r["doc_id"], bytes(r["payload"]).rstrip(b"\0").decode())))):
        assert bytes(r["payload"]) == media.padded(t.encode()) and len(r["rgb"]) == r["height"] * r["width"] * 3
    same = [r for r in rows if r["doc_id"] in (5, 6)]
    assert len({(r["feature"], bytes(r["media"])) for r in same}) == 1
    assert media.read(media.store(nothing)).count() == 0


def test_media_are_written_before_they_are_read(spark, data, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(media, "stored", lambda df, name: seen.append(plans_stored(df, name)) or seen[-1])
    rows = {r["doc_id"]: r for r in media.op2_media(spark, data).collect()}
    ((files, uri),) = seen
    on_disk = {r["doc_id"]: r for r in spark.read.parquet(uri).collect()}
    assert set(on_disk) == set(rows) and all(hashlib.sha256(bytes(on_disk[k]["media"])).hexdigest() == r["media_sha256"] for k, r in rows.items())
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in rows.values())
    media.write_tensors(files.limit(20), str(tmp_path / "rgb"))
    pixels = spark.read.parquet(str(tmp_path / "rgb")).collect()
    assert len(pixels) == 20
    for r in pixels:
        want = media.jpeg.rgb(next(iter(media.jpeg.decode([bytes(on_disk[r["doc_id"]]["media"])]))))
        assert bytes(r["rgb"]) == want.tobytes() and len(r["rgb"]) == r["height"] * r["width"] * 3


def test_media_of_null_files_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(media.encode(bytes(64))))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.read(df).collect()}
    assert got[1]["payload"] is None and got[1]["feature"] is None and bytes(got[2]["payload"]) == bytes(64)


class _Writer:
    """A plain bit writer for files with any coefficients."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - k)) & 1 for k in range(n)]

    def bytes(self):
        return np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes()


def _signed(v, n):
    return v if v > 0 else v + (1 << n) - 1


def _plain_progressive(coefs, rows, cols, bands=((1, 5), (6, 63))):
    """A grey file with zeros, runs, new coefficients in refinement and EOB runs, one block at a time."""
    # Every symbol has a code of eight or nine bits.
    table = lambda kind, number: media._table(kind, number, {9: list(range(255))})
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes(range(1, 65))), media._segment(0xC2, bytes((8, 0, rows * 8, 0, cols * 8, 1, 1, 0x11, 0)))]
    out += [table(0, 0), table(1, 0)]

    def scan(start, end, high, low, data):
        return media._segment(0xDA, bytes((1, 1, 0, start, end, high << 4 | low))) + data.replace(b"\xff", b"\xff\x00")

    w, last = _Writer(), 0
    for b in coefs:
        v = int(b[0]) >> 1
        d, last = v - last, v
        n = abs(d).bit_length()
        w.put(n, 9)
        w.put(_signed(d, n) if n else 0, n)
    out.append(scan(0, 0, 0, 1, w.bytes()))
    for lo, hi in bands:
        w, run = _Writer(), 0

        def flush():
            nonlocal run
            if run:
                r = run.bit_length() - 1
                w.put(r << 4, 9)
                w.put(run - (1 << r), r)
            run = 0

        for b in coefs:
            zeros = 0
            for k in range(lo, hi + 1):
                v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
                if v == 0:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    w.put(0xF0, 9)
                    zeros -= 16
                n = abs(v).bit_length()
                w.put(zeros << 4 | n, 9)
                w.put(_signed(v, n), n)
                zeros = 0
            run += zeros > 0
        flush()
        out.append(scan(lo, hi, 0, 1, w.bytes()))
    for lo, hi in bands:
        w = _Writer()
        for b in coefs:
            todo = [k for k in range(lo, hi + 1) if abs(int(b[k])) == 1]
            fixes, zeros = [], 0
            for k in range(lo, hi + 1):
                v = abs(int(b[k]))
                if v > 1:
                    fixes.append(v & 1)
                elif v == 0:
                    zeros += 1
                    if zeros == 16 and any(x > k for x in todo):
                        w.put(0xF0, 9)
                        for f in fixes:
                            w.put(f, 1)
                        fixes, zeros = [], 0
                else:
                    w.put(zeros << 4 | 1, 9)
                    w.put(int(b[k] > 0), 1)
                    for f in fixes:
                        w.put(f, 1)
                    fixes, zeros = [], 0
            if fixes or zeros:
                w.put(0, 9)
                for f in fixes:
                    w.put(f, 1)
        out.append(scan(lo, hi, 1, 0, w.bytes()))
    w = _Writer()
    for b in coefs:
        w.put(int(b[0]) & 1, 1)
    out.append(scan(0, 0, 1, 0, w.bytes()))
    return b"".join(out) + b"\xff\xd9"


def test_jpeg_decodes_general_progressive_scans():
    rng = np.random.default_rng(9)
    files, want = [], []
    for rows, cols in ((1, 1), (2, 3), (4, 4)):
        coefs = np.where(rng.random((rows * cols, 64)) < 0.3, rng.integers(-9, 10, (rows * cols, 64)), 0)
        coefs[:, 0] = rng.integers(-200, 200, rows * cols)
        coefs[-1, 1:] = 0
        files.append(_plain_progressive(coefs, rows, cols))
        want.append(coefs)
    for im, coefs in zip(jpeg.decode(files), want):
        assert (im.components[0].blocks.reshape(-1, 64) == coefs).all()
        table = np.arange(1, 65)
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
        block = np.zeros(64)
        block[jpeg.ZIGZAG] = coefs[0] * table
        plain = np.clip(np.rint(basis.T @ block.reshape(8, 8) @ basis + 128), 0, 255)
        assert np.abs(jpeg.rgb(im)[:8, :8, 0].astype(int) - plain).max() <= 1


def test_jpeg_refuses_other_files():
    for bad in (b"", b"GIF89a", b"\xff\xd8" + media._segment(0xC0, bytes(9))):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


# --- quality


def test_quality_agrees_with_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] == 1 for r in labels.collect()}
    rows = [r for r in quality.classify(docs).collect() if r["doc_id"] in truth]
    assert sum(r["kept"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_quality_weak_labels_recover_accuracies():
    rng = np.random.default_rng(10)
    truth, accuracy = rng.random(20_000) < 0.8, [0.95, 0.8, 0.7, 0.9]
    votes = Counter()
    for t in truth:
        votes["".join("0" if rng.random() < 0.2 else "+" if (rng.random() < a) == t else "-" for a in accuracy)] += 1
    model = quality.WeakLabels(votes)
    assert abs(model.good - 0.8) < 0.05 and np.abs(np.array(model.accuracies()) - accuracy).max() < 0.05


def test_quality_on_odd_rows(odd, nothing):
    rows = quality.classify(odd).collect()
    assert len(rows) == odd.count() and all(not r["kept"] for r in rows if r["doc_id"] in (0, 1, 2))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.classify(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


# --- decontamination


def test_tiles_cover_reordered_passages():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], np.uint64)
    b = np.array([7, 8, 9, 10, 11, 12, 99, 1, 2, 3, 4, 5, 6], np.uint64)
    assert decontamination.tiles(a, b, 5) == [(0, 7, 6), (6, 0, 6)]
    assert decontamination.tiles(a, a[::-1].copy(), 5) == [] and decontamination.tiles(a[:3], b, 5) == []


def plain_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest unmarked match first."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))


@pytest.mark.parametrize("letters", [1, 2, 4, 9])
def test_tiles_are_those_of_the_definition(letters):
    rng = np.random.default_rng(11)
    for _ in range(60):
        a, b = (rng.integers(0, letters, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
        if rng.random() < 0.5:
            b = np.concatenate([a[10:40], b[:8], a[:25]])
        assert decontamination.tiles(a, b, 3) == plain_tiles(a.tolist(), b.tolist(), 3)


def test_tiles_of_one_word_over_and_over_take_a_while_at_most():
    a, b = np.full(20_000, 7, np.uint64), np.full(500, 7, np.uint64)
    assert decontamination.tiles(a, b, 5) == [(0, 0, 500)]


def test_decontamination_finds_passages_and_leaves_others(spark, odd, nothing):
    item = " ".join(f"bench{i}" for i in range(30))
    halves = item.split()
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, " ".join(halves[15:]) + " between " + " ".join(halves[:15])), (3, " ".join(halves[:7]) + " only a little"), (4, None), (5, "Short item, here!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short ITEM"), (9, None), (None, "")], "item_id long, text string").withColumn("leaks", F.lit(1))
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: (True, [7]), 2: (True, [7]), 3: (False, []), 4: (False, []), 5: (True, [8])}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()) == [3, 4]
    assert decontamination.contaminated(odd, bench).count() == odd.count() and decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_in_blocks_is_the_same(spark, data, monkeypatch):
    docs, bench = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench).select("doc_id", "contaminated", "coverage").collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).select("doc_id", "contaminated", "coverage").collect())) == whole
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()) == [i for i, leaks, _ in whole if not leaks]


# --- language


def test_language_of_documents_and_pages(spark, data):
    docs, pages = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "pages"))
    rows = language.identify(docs, pages).collect()
    assert len(rows) == docs.count() + pages.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    own = [r for r in rows if r["doc_id"] is not None]
    assert sum(r["lang"] == truth[r["doc_id"]] for r in own) >= 0.97 * len(own)
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    there = [(m[1], r["lang"]) for r in rows if r["page_id"] is not None and (m := re.search(r"/(de|en|es|fr)\b", urls[r["page_id"]]))]
    assert sum(a == b for a, b in there) >= 0.95 * len(there)


def test_language_by_other_evidence_where_there_is_no_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(i, f"http://a.example.de/{i}", '<html lang="de"><body>der die das und nicht ein eine von mit</body></html>') for i in range(30)]
    rows += [(100, "http://a.example.de/x", '<html lang="de"></html>'), (101, None, None), (102, "::bad[", "<p"), (None, "", "<script>x")]
    got = {r["page_id"]: r for r in language.identify(docs, spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["doc_id"] is None}
    assert got[100]["lang"] == "de" and got[100]["probability"] > 0.9 and len(got) == 34
    assert language.visible("<p>a</p><script>var b='<i>'</script>c<style>d</style> e") .split() == ["a", "c", "e"]
    assert language.address("https://User@WWW.Example.CO.uk:80/x") == ("www.example.co.uk", "co.uk", "uk")


def plain_fusion(rows, languages):
    """Posteriors of (logs, declared, host, domain, suffix) by summing over all other rows."""
    n = len(languages)
    own = [np.exp(np.array(r[0]) - max(r[0])) for r in rows]
    own = [x / x.sum() for x in own]
    said = [r[1] if r[1] in (*languages, "") else "other" for r in rows]
    country = [language.SUFFIXES.get(r[4], "") for r in rows]
    out = []
    for k, r in enumerate(rows):
        rest = [i for i in range(len(rows)) if i != k]
        total = lambda same: sum((own[i] for i in rest if same(i)), np.zeros(n))  # noqa: B023, E731
        all_rows = total(lambda i: True)
        p = (all_rows + 1) / (all_rows.sum() + n)
        for same in (lambda i: rows[i][4] == r[4], lambda i: rows[i][3] == r[3], lambda i: rows[i][2:] == r[2:]):  # noqa: B023
            p = (total(same) + language.SMOOTHING * p) / (total(same).sum() + language.SMOOTHING)
        logs = np.array(r[0]) + np.log(p)
        logs += np.log((total(lambda i: said[i] == said[k]) + 1) / (all_rows + n + 2))  # noqa: B023
        logs += np.log((total(lambda i: country[i] == country[k]) + 1) / (all_rows + 1 + len(set(language.SUFFIXES.values()))))  # noqa: B023
        e = np.exp(logs - logs.max())
        out.append(e / e.sum())
    return out


def test_language_is_fused_as_by_summing_over_all_other_rows(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(60):
        domain, suffix = rng.choice([("a.de", "de"), ("b.de", "de"), ("c.fr", "fr"), ("d.org", "org"), ("", "")])
        host = f"{rng.choice(['www', 'm'])}.{domain}" if domain else ""
        rows.append(([rng.uniform(-3, 0) for _ in language.LANGUAGES], rng.choice(["", "de", "fr", "xx"]), host, domain, suffix))
    rows.append(([-1.0, -1.0, -1.0, -1.0], "", "alone.example", "alone.example", "example"))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "key long, logs array<double>, declared string, host string, domain string, suffix string")
    got = {r["key"]: (r["lang"], r["probability"]) for r in language.fused(df).collect()}
    for k, p in enumerate(plain_fusion(rows, language.LANGUAGES)):
        assert got[k][0] == language.LANGUAGES[int(p.argmax())] and abs(got[k][1] - p.max()) < 2e-6


def test_language_of_documents_that_trained_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) >= 200").withColumn("url", F.lit(None).cast("string"))
    table = language.likelihoods(docs.where("doc_id % 2 = 0"))
    found = language.fused(language.evidence(docs.where("doc_id % 2 = 1"), "doc_id", "text", "url", table, False))
    both = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("said_lang")).join(found, "key").where(F.col("said_lang").isin(list(language.LANGUAGES)))
    share, n = both.agg(F.avg((F.col("said_lang") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 30 and share > 0.9


def test_language_is_declared_wherever_the_tag_says_it():
    assert language.declared_language("<p><HTML data-x='" + "y" * 5000 + "' lang = 'DE-at'>") == "de"
    assert language.declared_language("<html><html lang=fr>") == "fr" and language.declared_language("<html " + "lang " * 50_000) == ""


def test_language_on_odd_rows(spark, odd, nothing):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(odd, pages).count() == odd.count()
    assert language.identify(nothing, pages).count() == 0


# --- shingles


def test_shingle_sets_count_distinct_sequences():
    rng = random.Random(12)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        want = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()
        assert len(shingles.shingle_set(" ".join(words), 4)) == len(want)
