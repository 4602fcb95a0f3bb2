"""Media, archives, packing, licences and decontamination: round trips and brute force."""

import base64
import collections
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from axisframe.llm import decontaminate, licenses, media, packing, warc
from axisframe.llm.queries import op6_iso_media_columns

from .conftest import corpus


def test_media_round_trip(docs, rows, none):
    texts = dict(rows)
    stored = media.stored(docs)
    got = media.read_back(stored).collect()
    assert len(got) == len(rows) and media.read_back(media.containers(none)).count() == 0
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(files[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(files[r["doc_id"]]).hexdigest()


def test_media_info_reads_sample_tables(spark, tmp_path):
    payload = bytes(range(256)) * 3 * 50
    data = media.write(payload)
    track = media.tracks(data)[0]
    assert track["sizes"].sum() == len(payload) and media._payload(data, track) == payload
    rows = [(1, data, "a"), (2, b"", "b"), (3, None, "c"), (4, data[:40], "d"), (5, b"\0\0\0\x10free12345678" + data, "e")]
    got = {r["k"]: r for r in media.media_info(spark.createDataFrame(rows, "k int, media binary, codec string")).collect()}
    n = len(payload) // 192
    assert got[1]["codec"] == "raw " and got[1]["n_samples"] == n and got[1]["duration"] == n and got[1]["timescale"] == 50
    first = got[1]["keyframes"][1]
    assert data[first["first"] : first["last"] + 1] == payload[64 * 192 : 65 * 192]
    assert got[2]["codec"] is got[3]["codec"] is got[4]["codec"] is None and got[5]["n_samples"] == n


def test_archives(spark):
    pages = [(1, "http://a/ b\r\nc", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (4, "v", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (5, "w", "x" * 200_000), (6, "w", "only"), (6, "w", "only"), (None, "n", "only")]
    pages += [(7, "w", "one text"), (7, "w", "another text"), (7, None, "another text"), (-5, "m", "below nought"), (-9, "m", "below nought"), (None, "n", "nobody's"), (None, "n", "nobody's"), (8, "w", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("block", F.lit("clash")).repartition(2)
    got = sorted((tuple(r) for r in warc.captures(df).collect()), key=str)
    best = {}
    for p, _, h in pages:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        revisit = p is not None and p < best[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.captures(df.limit(0)).count() == 0
    path = warc.write(df)
    whole = {r["metadata"]["fields"]: r for r in warc.transactions(warc.read(spark, path)).collect()}
    one = whole["pageId: 4\r\nhasUrl: true\r\n"]
    assert bytes(one["response"]["payload"]).decode() == pages[3][2] and one["request"]["http_header"].startswith("GET v") and one["response"]["payload_bytes"] == len(pages[3][2].encode())
    assert whole["pageId: 6\r\nhasUrl: true\r\n"]["copies"] == 2
    # Long payloads have files of their own.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert {r["part"] for r in files.select(F.regexp_extract("path", "/(long|short)/", 1).alias("part")).collect()} == {"long", "short"}


def test_records_end_by_their_length():
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 12\r\n\r\na\r\n\r\nWARC/1.\r\n\r\n"
    assert [b for _, b in warc.records(one * 3)] == [b"a\r\n\r\nWARC/1."] * 3
    with pytest.raises(ValueError):
        list(warc.records(one + b"rubbish"))


def test_packing(spark, docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    texts = [*rows, (None, "null id <|endoftext|>"), (6, "again"), (70, "a <|endoftext|> b<|endoftext|>"), (71, "<|endoftext"), (72, "It's 2024's\t\n  ünï 漢字 🙂 'll  \r\n\x00 end ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = packing.pack(df, path, run_tokens=3000).collect()
    want = collections.Counter()
    for d, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids)] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    held = collections.Counter()
    for r in got:
        held[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert held == {k: k[1] * m for k, m in want.items()}
    # Every piece has the ids that the library gives there.
    of = collections.defaultdict(list)
    for d, text in texts:
        of[d].append(np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got:
        assert any(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in of[r["doc_id"]])
    assert packing.pack(none, path).count() == 0


def test_ids_are_those_of_the_library(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, odd = tokenizers.Tokenizer.from_file(path), "x <|endoftext|> y <|endoftext|><|endo"
    ids = lambda own, text: np.frombuffer(own.encode(text), "<u4").tolist()
    plain = packing.Tokenizer(path)
    assert plain.fast and ids(plain, odd) == model.encode(odd, add_special_tokens=False).ids and 50256 in ids(plain, odd)
    model.encode_special_tokens = True
    assert ids(packing.Tokenizer(path, special_as_text=True), odd) == model.encode(odd, add_special_tokens=False).ids
    # A file that does more to a text than cutting and merging is left to the library.
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    vocabulary["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(vocabulary))
    other = packing.Tokenizer(str(tmp_path / "other.json"))
    assert other.fast is None and ids(other, "a b") == tokenizers.Tokenizer.from_file(other.path).encode("a b", add_special_tokens=False).ids != ids(plain, "a b")
    assert not packing.Tokenizer.is_plain(vocabulary | {"pre_tokenizer": None})


def test_differencing_is_near_equal():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 300, 400)
    own = packing.windows(sizes, 2048)
    sums = np.bincount(own, sizes)
    assert sums.max() <= 2048 and np.ptp(sums) < 100 and len(sums) <= -(-sizes.sum() // 2048) + 1
    assert packing.windows(np.array([2048, 2048, 1]), 2048).max() == 2


def test_licences(spark, none):
    mit = "\n\n".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liable"))
    rows = [(1, "Copyright me\n\n" + mit.replace("copies of", "copies\n  of")), (2, "text\n  released UNDER the MIT license.\nmore"), (3, "Released under the MIT License and more."), (4, None), (5, ""), (6, licenses.SENTENCES["bsd-use"] + " " + licenses.SENTENCES["bsd-source"])]
    rows += [(7, " ".join(licenses.SENTENCES[k] for k in ("gpl-3-free", "gpl-hope", "gpl-see"))), (8, " ".join(licenses.SENTENCES[k] for k in ("mpl-subject", "mpl-copy"))), (2, rows[1][1]), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["licence"], r["rule"], r["n_sentences"]) for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash"))).collect()}
    assert got == {(1, "MIT", "mit-text", 3), (2, "MIT", "line-mit", 1), (7, "GPL-3.0-or-later", "gpl-3-header", 3), (8, "MPL-2.0", "mpl-header", 2)}
    assert licenses.licences(none).count() == 0


def test_licences_as_they_are_laid_out(spark):
    s = licenses.SENTENCES
    bsd = f"{s['bsd-use']}\n1. {s['bsd-source']}\n2. {s['bsd-binary']}\n3. {s['bsd-endorse']}\n\n{s['bsd-as-is']}"
    comment = lambda sign, *names: "\n".join(sign + line for line in "  ".join(s[k] for k in names).replace(", ", ",\n").split("\n"))
    rows = [
        (1, bsd),
        (2, bsd.replace("\n3. " + s["bsd-endorse"], "").replace("1.", "a)").replace("2.", "b)")),
        (3, comment("# ", "apache-head") + "\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n" + comment("# ", "apache-as-is", "apache-see")),
        (4, "/*\n" + comment(" * ", "gpl-3-free", "gpl-hope", "gpl-see") + "\n */\nint main() {}"),
        (5, "A tool for owls. Licensed under the MIT License. It has no bugs."),
        (6, f"{s['bsd-use']} 1. {s['bsd-source']} 2. {s['bsd-binary']} {s['bsd-as-is']}"),
        (7, comment("// ", "gpl-2-free", "gpl-hope", "gpl-see", "gpl-classpath")),
        (8, "<!-- SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception -->\n" + "no end " * 60_000),
        (9, comment("-- ", "lgpl-2-free", "lgpl-2-hope", "lgpl-see") + "\n\n" + s["line-mit"]),
        (10, "; " * 50_000 + "1. " * 50_000 + "license"),
        (11, s["mit-grant"] + "\n" + s["mit-as-is"]), (11, s["mit-grant"] + "\n" + s["mit-as-is"]),
    ]
    got = collections.defaultdict(set)
    for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["licence"])
    bsd2, bsd3 = "BSD-2-Clause", "BSD-3-Clause"
    assert got == {1: {bsd3}, 2: {bsd2}, 3: {"Apache-2.0"}, 4: {"GPL-3.0-or-later"}, 5: {"MIT"}, 6: {bsd2}, 7: {"GPL-2.0-or-later", "GPL-2.0-or-later WITH Classpath-exception-2.0"}, 8: {"Apache-2.0 WITH LLVM-exception"}, 9: {"LGPL-2.1-or-later", "MIT"}, 11: {"MIT"}}


def test_every_licence_rule_matches_its_sentences(spark):
    rows = [(k, "\n\n".join(licenses.SENTENCES[x] for x in ids)) for k, (_, _, ids) in enumerate(licenses.RULES)]
    got = {(r["doc_id"], r["rule"]) for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {(k, rule) for k, (rule, _, _) in enumerate(licenses.RULES)}
    assert len({licenses.normalised(x) for x in licenses.SENTENCES.values()}) == len(licenses.SENTENCES)


def test_decontamination(spark, none):
    items = [(1, "Yesterday Tom bought 5 apples and 7 pears for 5 dollars in the small shop of Anna Smith near the river."), (2, "what colour is it"), (3, None), (4, ""), (None, "a null item is nobody's leak at all today")]
    far = corpus(5)[6][1]
    rows = [
        (10, "x y. Yesterday Mary bought 12 apples and 30 pears for 12 dollars in the small shop of Jo Doe near the river. z"),
        (11, far + " Yesterday Tom bought 5 apples and 7 pears for 5 dollars in the small shop of Anna Smith near the river " + far),
        (12, "Yesterday rain fell in the small shop of a man near the sea and nothing more was said of it"),
        (13, "so what colour, is it then"), (14, None), (15, ""), (16, far), (None, items[0][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit(0))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(2)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2)}
    assert got[10, 1]["share"] == 1 and got[10, 1]["slots"] == 6 and got[10, 1]["slots_consistent"]
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {12, 14, 15, 16, None}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_inconsistent_slots_do_not_count(spark):
    bench = spark.createDataFrame([(1, "the sum of 3 and 4 and 3 is 10 and 4 and 3 are 7 so 10 it is")], "item_id long, text string")
    df = spark.createDataFrame([(1, "the sum of 5 and 6 and 5 is 20 and 6 and 5 are 9 so 20 it is"), (2, "the sum of 1 and 2 and 3 is 4 and 5 and 6 are 7 so 8 it is")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(df, bench, 0.0).collect()}
    assert got[1]["slots_consistent"] and got[1]["share"] == 1
    assert not got[2]["slots_consistent"] and got[2]["share"] < 0.7


def test_equal_texts_equal_media(spark, tmp_path):
    spark.createDataFrame([(1, "same"), (2, "same")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = op6_iso_media_columns(spark, str(tmp_path)).drop("doc_id").collect()
    assert a == b


def test_decontamination_misses_no_window(spark):
    short, sums = "grey owls rarely visit our northern barn twice", "12 + 47 = 59; 88 + 11.5 = 99.5; 31 + 6 kg = 37 kg"
    slots = "Take {} and {} and {} then add {} and {} and {}, {}, {}, {}, {}, {}, {}"
    items = [(1, short), (2, sums), (3, slots.format(*range(12)))]
    docs = [(k, "so " * k + short + " and more") for k in range(4)] + [(10, f"We know: {sums}."), (11, sums.replace("59", "60").replace("88", "77").replace("31", "41").replace("6 kg", "3 kg"))]
    docs += [(20, slots.format(*range(20, 32)) + " or " + slots.format(*range(51, 39, -1))), (21, slots.format(*[5, 6] * 6))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["share"]) for r in got} == {(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (10, 2, 1), (20, 3, 1)}


def test_decontamination_of_long_runs_of_names(spark):
    docs = spark.createDataFrame([(1, "so " + "Anna " * 20000 + "1.2" * 20000)], "doc_id long, text string")
    assert decontaminate.leaks(docs, spark.createDataFrame([(1, "we all know what 3 owls of the barn eat")], "item_id long, text string")).count() == 0


def test_exact_templates_keep_places(spark):
    text = "Yesterday the man Tom Jones saw 3.5 kg of 12,7 apples; old Anna said 5/6 and 7km, A1 2"
    r = spark.createDataFrame([(text,)], "text string").select(decontaminate.tokens(F.col("text")).alias("t"), decontaminate.exact(F.col("text")).alias("e")).first()
    assert len(r["t"]) == len(r["e"]) and all(e == t or e.startswith(t) and t[0] == "§" for t, e in zip(r["t"], r["e"]))
    assert "§ntomʘjones" in r["e"] and "§d3ʘ5" in r["e"]


def test_long_lists_take_time_in_proportion(spark):
    """A megabyte of numbers, and one of names: the patterns begin each once."""
    import time

    rows = [(1, "a " + "1," * 500_000), (2, "the " + "Abcde " * 170_000), (3, "1.5/2:3" * 100_000)]
    df = spark.createDataFrame(rows, "k long, text string")
    began = time.time()
    got = {r["k"]: r for r in df.select("k", F.size(decontaminate.tokens(F.col("text"))).alias("t"), F.size(decontaminate.exact(F.col("text"))).alias("e"), F.size(decontaminate.slots(F.col("text"))["d"]).alias("d")).collect()}
    assert time.time() - began < 60
    assert (got[1]["t"], got[1]["e"], got[1]["d"]) == (2, 2, 1) and (got[2]["t"], got[2]["e"]) == (2, 2) and got[3]["d"] == 1


def test_templates_of_names_numbers_and_units(spark):
    text = "n we saw Ann Bell and 12 kg, then New York City with 3.5/2 km or 7, 1,000 miles"
    got = spark.createDataFrame([(text,)], "text string").select(decontaminate.tokens(F.col("text")), decontaminate.exact(F.col("text")), decontaminate.slots(F.col("text"))).first()
    assert got[0] == "n we saw §n and §d §u then §n with §d §u or §d §d §u".split()
    assert len(got[1]) == len(got[0]) and [e[2:] for e in got[1] if e.startswith("§")] == ["annʘbell", "12", "kg", "newʘyorkʘcity", "3ʘ5ʘ2", "km", "7", "1ʘ000", "miles"]
    assert (got[2]["n"], got[2]["d"], got[2]["u"]) == (["ann bell", "new york city"], ["12", "3.5/2", "7", "1,000"], ["kg", "km", "miles"])


def test_templates_are_worked_out_once(spark):
    """Each of the patterns runs over a text once, with nothing lost at its ends, and odd texts have no empty tokens."""
    rows = ["", " ", "--", "§", "§ 3", " a  b ", "...a", "7", "x 7 kg", "ÄÖ  Ünï,é", "\ta\n\nb\u00a0c ", "3.5.", None, "12kg12", "a§nb"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, text string")
    for form, patterns in ((decontaminate.tokens, 4), (decontaminate.exact, 5)):
        made = df.select("k", form(F.col("text")).alias("t"))
        assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == patterns
        got = {r["k"]: r["t"] for r in made.collect()}
        assert all("" not in t for t in got.values()) and [got[k] for k in (0, 1, 2, 3, 12)] == [[]] * 5
    got = {r["k"]: r["t"] for r in df.select("k", decontaminate.tokens(F.col("text")).alias("t")).collect()}
    assert [got[k] for k in range(4, 12)] == [["§d"], ["a", "b"], ["a"], ["§d"], ["x", "§d", "§u"], ["äö", "ünï", "é"], ["a", "b", "c"], ["§d"]]
    assert got[13] == ["§d", "kg", "§d"] and got[14] == ["a", "nb"]


def test_runs_of_many_small_documents_are_bounded():
    sizes = np.ones(1 << 14, np.int64)
    own = packing.windows(sizes, 2048)
    assert np.bincount(own).max() <= 2048


def test_many_small_documents_are_packed_in_bounded_runs(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), run_documents=64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("doc_id").alias("docs")).collect()
    assert sum(r["docs"] for r in got) == 700 and max(r["docs"] for r in got) <= 64


def _licence_texts():
    """Whole public texts, with what they are, as they are usually set."""
    s = licenses.SENTENCES
    name = "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    advert = s["bsd-advert"] + " This product includes software developed by the Example organization."
    bsd = [s["bsd-source"], s["bsd-binary"]]
    grant = "Copyright (c) 2020 Example Inc. All rights reserved."
    texts = {"BSD-2-Clause": bsd, "BSD-3-Clause": [*bsd, name], "BSD-4-Clause": [*bsd, advert, s["bsd-endorse"].replace("the copyright holder", "the Example organization")]}
    out = {}
    for licence, clauses in texts.items():
        for layout, join in {
            "numbered": "\n".join(f"{k}. {c}" for k, c in enumerate(clauses, 1)),
            "bullets": "\n".join(f" * {c}" for c in clauses),
            "apart": "\n\n".join(f"{k}. {c}" for k, c in enumerate(clauses, 1)),
            "one line": " ".join(clauses),
            "one numbered line": " ".join(f"{k}. {c}" for k, c in enumerate(clauses, 1)),
        }.items():
            between = " " if "one" in layout else "\n\n" if layout == "apart" else "\n"
            out[licence, layout] = f"{grant}{between}{s['bsd-use']}{between}{join}{between}{s['bsd-as-is']} IN NO EVENT SHALL ANYONE BE LIABLE."
    mit = [s["mit-grant"], s["mit-notice"], s["mit-as-is"], s["mit-liable"]]
    out["MIT", "apart"], out["MIT", "one line"] = f"MIT License\n\n{grant}\n\n" + "\n\n".join(mit), f"{grant} " + " ".join(mit)
    for licence, names in {"ISC": ("isc-grant", "isc-as-is"), "Apache-2.0": ("apache-head", "apache-copy", "apache-as-is", "apache-see"), "GPL-2.0-or-later": ("gpl-2-free", "gpl-hope", "gpl-see"), "GPL-3.0-or-later": ("gpl-3-free", "gpl-hope", "gpl-see")}.items():
        for layout, lead in {"text": "", "hashes": "# ", "slashes": "// "}.items():
            # The address stands on a line of its own.
            address = lambda k: s[k].replace(" at http", f" at\n{lead}\n{lead}    http") + f"\n{lead}" * (k == "apache-copy")  # noqa: B023, E731
            out[licence, layout] = "\n".join(f"{lead}{address(k)}" for k in names) + "\n\nint main() {}"
    return out


def test_whole_licence_texts_get_their_own_licence(spark):
    texts = _licence_texts()
    rows = list(enumerate(texts.values()))
    got = {}
    for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    assert {(licence, layout): got.get(k) for k, (licence, layout) in enumerate(texts)} == {(licence, layout): {licence} for licence, layout in texts}


def test_nothing_matches_across_foreign_sentences(spark):
    s = licenses.SENTENCES
    foreign = " ".join(f"Sentence number {k} is about something else." for k in range(500))
    odd = "Redistributions must send a postcard to the author."
    rows = [(1, f"{s['mit-grant']}\n{foreign}\n{s['mit-notice']} {s['mit-as-is']}"), (2, "\n".join([s["bsd-use"], s["bsd-source"], s["bsd-binary"], odd, s["bsd-as-is"]]))]
    assert licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
