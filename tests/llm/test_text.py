import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphex.llm import mixing as M
from morphex.llm import residue as R
from morphex.llm import terms, tokens
from morphex.llm.packing import Plan, pack, pack_report
from morphex.llm.residue import residue_documents, without_residue
from morphex.operators import ranks


def test_terms_against_counting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", " hot\t", f"t{rng.randrange(40)}", None, " ", "é", "E"]), rng.choice([f"i{rng.randrange(60)}", None]), rng.choice([f"s{rng.randrange(6)}", None, " "])) for _ in range(1500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "value string, image string, sample string, term string").repartition(6)
    want = {}
    for v, i, s in rows:
        if v and v.strip(" \t"):
            n = want.setdefault(v.strip(" \t"), [0, set(), set()])
            n[0] += 1
            n[1] |= {i} - {None}
            n[2] |= {s} - {None, " "}
    got = {r.term: (r.n_rows, r.n_images, r.n_samples, r.mark) for r in terms.term_frequencies([(df, "value", "image", "sample", "value")]).collect()}
    mark = lambda i, s: "rare" if i < 3 else "common" if s > 3 else None
    assert got == {t: (n, len(i), len(s), mark(len(i), len(s))) for t, (n, i, s) in want.items()}
    assert terms.term_frequencies([(df.limit(0), "value", "image", "sample", "value")]).count() == 0


def test_run_scan_carries_over_batches():
    rows = sorted([("f", "image", "a", "1")] * 5 + [("f", "image", "a", "2")] * 3 + [("f", "image", "b", "2"), ("g", "image", "b", "2")])
    rows = [("f", "image", "a", None)] * 2 + rows
    for size in (1, 2, 3, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + size]], pa.string()) for i in range(4)] + [pa.array([1] * len(rows[a : a + size]))], names=["field_name", "kind", "term", "record", "weight"]) for a in range(0, len(rows), size)]
        total = Counter()
        for b in terms.scan_runs(iter(batches)):
            for r in b.to_pylist():
                total[r["field_name"], r["term"], "rows"] += r["rows"]
                total[r["field_name"], r["term"], "records"] += r["records"]
        assert total == {("f", "a", "rows"): 10, ("f", "a", "records"): 2, ("f", "b", "rows"): 1, ("f", "b", "records"): 1, ("g", "b", "rows"): 1, ("g", "b", "records"): 1}


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, n long").repartition(5)
    got = {(r.k, r.id): (r.position, r.offset) for r in ranks.with_positions(df, ["k"], ["id"], "n").collect()}
    at, total = Counter(), Counter()
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        assert got[k, i] == (at[k], total[k])
        at[k] += 1
        total[k] += n
    assert ranks.with_positions(df.limit(0), ["k"], ["id"]).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> 物种 " * 20_000), (5, "a" * 150_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df).collect()}
    encode = tokens.encoder().encode_ordinary
    assert got[1] == len(encode("Hello world")) and got[2] == got[3] == 0 and abs(got[4] - len(encode("<|endoftext|> 物种 ")) * 20_000) < 20_010 and got[5] > 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 300])
    counts = {x: rng.randrange(1, 60) for x in rng.sample(range(1, capacity + 1), min(capacity, 25))}
    p = Plan(counts, capacity)
    load = Counter()
    for length, runs in p.runs.items():
        ends = [r for r, _ in runs[1:]] + [counts[length]]
        for (rank, first), end in zip(runs, ends):
            for i in range(end - rank):
                load[first + i] += length
    assert sum(load.values()) == sum(x * n for x, n in counts.items()) and max(load.values()) <= capacity and set(load) == set(range(p.containers))
    # no worse than first-fit decreasing by item
    bins = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [i for i, b in enumerate(bins) if b + x <= capacity]
        if fit:
            bins[fit[0]] += x
        else:
            bins.append(x)
    assert p.containers <= len(bins) * 1.02 + 1


def test_packing(spark):
    items = spark.createDataFrame([(1, 10), (2, 3), (2, 3), (3, 25), (4, 0), (5, None), (6, 7)], "doc_id long, n_tokens long")
    rows = pack(items, 10).collect()
    load, of = Counter(), Counter()
    for r in rows:
        load[r.container] += r.n_tokens
        of[r.doc_id] += r.n_tokens
    assert of == {1: 10, 2: 6, 3: 25, 6: 7} and max(load.values()) <= 10 and sorted(r.n_tokens for r in rows if r.doc_id == 3) == [5, 10, 10]
    report = pack_report(pack(items, 10), 10).first()
    assert (report.tokens, report.containers, report.least) == (48, 5, 5)
    assert pack(items.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        pack(items, 0)


def test_schedule_never_strays_a_block():
    rng = random.Random(0)
    for _ in range(20):
        blocks = [rng.randrange(1, 120) for _ in range(rng.randrange(1, 7))]
        order = M.schedule(blocks, [float(b) for b in blocks])
        assert sorted(order) == sorted((s, i) for s, n in enumerate(blocks) for i in range(n))
        total, seen = sum(blocks), [0] * len(blocks)
        for t, (s, i) in enumerate(order, 1):
            assert i == seen[s]
            seen[s] += 1
            assert all(abs(k - t * n / total) < 1 + 1e-6 for k, n in zip(seen, blocks))


def test_plan_mix():
    t = [("a", 0.5, 2), ("b", 0.3, 1), ("none", 0.2, 4)]
    assert M.plan_mix({"a": 100, "b": 1000}, t) == {"a": 200, "b": 120}
    assert M.plan_mix({}, t) == {}
    assert M.plan_mix({"a": 100, "b": 1000}, t, total=600) == {"a": 200, "b": 400}


def test_frames_never_stray_two_blocks(monkeypatch):
    monkeypatch.setattr(M, "FRAME_BLOCKS", 50)
    blocks = (331, 77, 190, 3)
    slots = [M.slots_of(s, np.arange(n), blocks) for s, n in enumerate(blocks)]
    assert sorted(np.concatenate(slots).tolist()) == list(range(sum(blocks))) and all((np.diff(x) > 0).all() for x in slots)
    for x, n in zip(slots, blocks):
        done = np.searchsorted(x, np.arange(sum(blocks)), side="right")
        assert np.abs(done - np.arange(1, sum(blocks) + 1) * n / sum(blocks)).max() < 2


def test_shortfall_of_a_given_total(spark, monkeypatch):
    monkeypatch.setattr(M, "FRAME_BLOCKS", 7)
    docs = spark.createDataFrame([(i, "big", 20) for i in range(1000)] + [(5000 + i, "small", 20) for i in range(50)], "doc_id long, source string, n_tokens long")
    goal = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = M.mix(docs, goal, total="available")
    by = {r.source: r for r in shares.collect()}
    assert by["small"].n_tokens == 2000 and by["small"].most_repeats == 2 and by["small"].actual_share < 0.5 and by["big"].n_tokens == 19_000
    assert len({(r.slot, r.position, r.source) for r in chosen.collect()}) == chosen.count() == 950 + 100


def test_mixing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, rng.choice(["big", "big", "big", "small"]), rng.randrange(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "big", 0), (9003, "other", 7)], "doc_id long, source string, n_tokens long")
    goal = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "small", 0.5, 3), ("m", "absent", 0.1, 2), ("empty", "absent", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = M.mix(docs, goal)
    rows = chosen.collect()
    by = {(r.mix_name, r.source): r for r in shares.collect()}
    assert by["m", "absent"].n_tokens == 0 == by["empty", "absent"].actual_share and {r.source for r in rows} == {"big", "small"}
    assert by["m", "big"].actual_share == pytest.approx(4 / 9, abs=0.01) and by["m", "small"].actual_share == pytest.approx(5 / 9, abs=0.01)
    assert len({(r.doc_id, r.repeat) for r in rows}) == len(rows) and max(r.repeat for r in rows if r.source == "small") <= 2 and max(r.repeat for r in rows if r.source == "big") == 0
    total, share = 0, {"big": 0, "small": 0}
    for r in sorted(rows, key=lambda r: (r.slot, r.position)):
        total += r.n_tokens
        share[r.source] += r.n_tokens
        assert all(abs(share[s] - total * by["m", s].actual_share) <= M.BLOCK + 2 * 60 for s in share)
    with pytest.raises(ValueError):
        M.mix(docs, goal.union(spark.createDataFrame([("m", "big", 0.2, 1)], goal.schema)))


CASES = [
    "Locality: {{site}}", "Temperature ${x.y} today.", "Leg. <insert name>", "Leg. &lt;your locality&gt;", "No [[sample]] was seen.", "It is %TAXON% here.", "Das {{ Art }} ist da.", "日期: {{采集地}}张", "A TBD plate.", "Take XX µm.", "by *|NAME|* and", "Cutoff: *|rec.id|*",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "asdf asdf asdf asdf", "test test test test test test test", "Click to edit your description.", "示例内容示例内容示例内容", "Home > Plates\n<div>404 Not Found</div>\nBack", "HTTP Error 503 - service unavailable", "Please enable JavaScript in your browser.",
    "请启用JavaScript以查看本页。", "Traceback (most recent call last):\n  File \"x.py\", line 3, in f\nKeyError: 'a'", "Your session has expired.", "Zugriff verweigert.", "Votre navigateur ne prend pas en charge les scripts.", '{"error": 404, "message": "not found"}', "A good note. You need to turn on client-side scripting! The end.",
]
PLAIN = [
    None, "", " ", "A plain note of 12 beetles.", 'The plate viewer answered with "404 Not Found" for IMG_1.jpg until Monday.', "The printer fills {{taxon}} and {{site}} from the sheet, all labels came out.", "In the label template the marker ${locality} stands for the site.", "We switched off JavaScript in the viewer.",
    "El visor funciona sin JavaScript en el equipo.", "服务器错误已修复,图像全部上传。", "The set {OTU_1, OTU_2} was split [in part].", "Values above 33% are given as %cover and below it as counts [sic].", "The student report had lorem ipsum left in its abstract.", "The todo list of May is finished.", "Access to the tray room was denied to visitors.",
    "Exception: in Aus bus the elytron is dull; at line 12 of the key go on.", "Males have XY and females XX chromosomes.", "<p>Cookies and tea were served.</p>", "Use `%(label)s` in the naming rule.", "The error bars [n = 12] cover <0.3 mm> in each direction.", "A timeout of 10 minutes lets the lamp cool.", "x" * 100_000,
]


def test_residue(spark):
    rows = [(i, t, "a", "extra") for i, t in enumerate(CASES)] + [(1000 + i, t, None, "extra") for i, t in enumerate(PLAIN)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    found = {r.doc_id for r in residue_documents(df).collect()}
    assert sorted(set(range(len(CASES))) - found) == [] and sorted(found - set(range(len(CASES)))) == []
    assert {r.doc_id for r in without_residue(df).collect()} == {1000 + i for i in range(len(PLAIN))}
    assert residue_documents(df.limit(0)).count() == 0


def test_shared_messages_must_recur(spark):
    one = spark.createDataFrame([(1, "Thank you for your patience.", "a")], "doc_id long, text string, source string")
    assert residue_documents(one).count() == 0
    many = spark.createDataFrame([(i, f"Note {i}.\nThank you for your patience.", f"s{i % 2}") for i in range(4)], one.schema)
    assert residue_documents(many).count() == 4


#: An example of every rule, in the rules' order.
EXAMPLES = {
    "PLACEHOLDERS": ["the {{ x }} here", "the ${x} here", "the <<name>> here", "the [[name]] here", "the {% if x %} here", "the @@name@@ here", "the *|name|* here", "the %(name)s here", "the __name__ here", "the {name} here", "the [insert name] here", "leg. TK here", "the xxx here"],
    "FILLER": ["replace with dummy copy", "add dummy", "this is filler", "your caption here", "hier steht sp", "su descripción aquí", "ici viendra", "正文待补充", "test 1 test 2"],
    "NOTICES": ["turn on scripts", "this viewer needs scripts", "js is required", "your browser blocks", "please try another browser", "aktivieren sie js", "merci d'accepter js", "debe activar js", "您的浏览器未支持"],
    "FAILURES": ["bad request", "404 - not acceptable", "status 5:", '{"code": 1, "reason": "x"}', "the requested resource does not exist", "sorry, but no", "this plate is not available right now", "you have been signed out", "deprecated: call to x", "unable to contact the host", "dns_probe_finished_nxdomain", "the site is down", "wartungsarbeiten", "veuillez vous reconnecter", "sitio en mantenimiento", "页面走丢了"],
    "SHARED": ["oops!", "please wait and retry.", "vuelva a intentarlo", "site name: ??"],
}
MORE = ["method not allowed", "payment required", "not acceptable", "request timeout", "servicio no disponible", "el servicio no está disponible", "temporarily down for repairs", "please enable js"]


def test_every_rule_finds_its_example(spark):
    rules = [(x, rule) for kind, examples in EXAMPLES.items() for x, rule in zip(examples, R.PLACEHOLDERS.values() if kind == "PLACEHOLDERS" else getattr(R, kind), strict=True)]
    df = spark.createDataFrame([(x, rule) for x, rule in rules], "text string, rule string")
    cut = R.with_messages(df, F.col("text"))
    assert {r.text for r in cut.where(F.regexp_like("message", F.col("rule"))).collect()} == set(df.toPandas().text)
    texts = [x for x, _ in rules] + MORE
    docs = spark.createDataFrame([(f"{i}", x, f"s{n % 2}") for i, x in enumerate(texts) for n in range(4)], "doc_id string, text string, source string")
    found = {int(r.doc_id) for r in residue_documents(docs).collect()}
    assert [x for i, x in enumerate(texts) if i not in found] == []


def test_what_a_rule_matches_has_its_cue(spark):
    groups = {"PLACEHOLDERS": list(R.PLACEHOLDERS.values()), **{k: getattr(R, k) for k in ("FILLER", "NOTICES", "FAILURES", "SHARED")}}
    for kind, patterns in groups.items():
        beginnings, needles = R.cue_of(patterns)
        assert "" not in beginnings and "" not in needles
        texts = [*CASES, *PLAIN, *MORE, *(x for e in EXAMPLES.values() for x in e)]
        cut = R.with_messages(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"))
        lost = cut.where(F.col("message").rlike(R._any(patterns)) & ~R._shown(F.col("message"), patterns))
        assert [r.message for r in lost.collect()] == [], kind
    with pytest.raises(ValueError):
        R.cue_of([r"\w+"])
    # choices, repeats, optional parts and marks of any length
    assert R.cue_of([r"^(?:the )?(?:page|site) is \w+"]) == ({"page", "site", "the "}, set())
    assert R.cue_of([r"^x{2,5}!"])[0] == {"xx!", "xxx!", "xxxx"} and R.cue_of([r"\w+abc{2}d?"]) == (set(), {"abcc"})


def test_long_and_cut_placeholders(spark):
    long = "some words of an expression " * 8
    marks = [("{{ ", " }}"), ("${", "}"), ("<<", ">>"), ("[[", "]]"), ("{% ", " %}"), ("<% ", " %>"), ("*|", "|*")]
    texts = [f"The plate {a}{x}{b} of May." for a, b in marks for x in (long, "if wide\n then short", "see p. below. Or above")]
    texts += [f"The plate [insert {long}] of May.", f"The plate @@{long}@@ of May."]
    plain = ["A set {a. b} and [c.\n d] of x < y. z > y.", f"An open {{{{ mark. {long}", "Two | bars. And | more * of it."]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string").withColumn("source", F.lit("a"))
    found = {r.doc_id for r in residue_documents(docs).collect()}
    assert [x for i, x in enumerate(texts) if i not in found] == [] and found == set(range(len(texts)))
