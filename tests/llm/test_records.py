import datetime
import random
import re

import numpy as np

from factloom.llm import leaks, mixture, spam, survivors

UNITS = "unit_id long, name string, module_name string, main_file string, output_file string, is_swiftpm_plugin_tool boolean, toolchain string, target_triple string, recorded_at timestamp_ntz, path string, kind string"


def unit(i, module, main, output, chain="6", triple="x", at=1, tool=None):
    return (i, "n", module, main, output, tool, chain, triple, datetime.datetime(2025, 1, at) if at else None, "clash", "clash")


def run(spark, rows):
    return {r["group_id"]: r for r in survivors.survivors(spark.createDataFrame(rows, UNITS)).collect()}


def test_survivors(spark):
    rows = [
        unit(1, " M\t", "/b/./x/../A.swift", "/o/debug/M.build/A.o", at=1), unit(2, "-", "file:///b/A.swift", "/o/debug/M.build/A.o", at=2), unit(3, None, "/b//A.swift\n", "/o/debug/M-tool.build/A.o", at=3),
        unit(4, "M", "/b/A.swift", "/o/my-tool.builder/A.o", chain="unknown", at=9), unit(5, "M", "/b/B%20.swift", None), unit(6, "MTests", "/b/A.swift", None), unit(7, None, "/b/A.swift", ""), unit(8, None, None, None), unit(9, "M", "/b/A-2.swift", None),
        unit(10, "M", "file:///c/S%20C/D.swift", "/o/release/M.build/D.o", at=None), unit(11, "M", "/c/S C/D.swift", "/o/release/M.build/D.o", at=None),
    ]
    got = run(spark, rows)
    assert {g: (r["survivor_id"], r["n_records"]) for g, r in got.items()} == {1: (1, 4), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 1), 9: (9, 1), 10: (11, 2)}
    assert got[1]["module_name"] == "M" and got[1]["main_file"] == "/b/A.swift" and got[10]["main_file"] == "/c/S C/D.swift"
    assert run(spark, []) == {}
    alone = survivors.survivors(spark.createDataFrame(rows, UNITS), fields=()).collect()
    assert {r["group_id"]: (r["survivor_id"], r["n_records"]) for r in alone} == {g: (r["survivor_id"], r["n_records"]) for g, r in got.items()}


def test_learned_order_fills_fields_without_timestamps(spark):
    # In every timestamped group release follows debug, so an untimed release is more current than a timed debug.
    rows = [unit(10 * g + k, "M", f"/g{g}.swift", f"/o/{kind}/M.build/x{g}.o", at=at) for g in range(5) for k, (kind, at) in enumerate((("debug", 1), ("release", 2)))]
    rows += [unit(90, "M", "/z.swift", "/o/debug/M.build/z.o", at=5), unit(91, "M", "/z.swift", "/o/release/M.build/z.o", at=None)]
    assert run(spark, rows)[90]["output_file"] == "/o/release/M.build/z.o" and run(spark, rows)[90]["survivor_id"] == 90


def test_own_timestamps_come_before_learned_transitions(spark):
    # Over all groups release follows debug, arm follows x86 and the flag turns on.
    rows = [unit(10 * g + k, "M", f"/g{g}.swift", f"/o/{v}/M.build/x{g}.o", at=at) for g in range(4) for k, (v, at) in enumerate((("debug", 1), ("release", 2)))]
    rows += [unit(100 + 10 * g + k, "N", f"/g{g}.swift", f"/o/{v}/debug/N.build/x{g}.o", at=at, tool=tool) for g in range(4) for k, (v, at, tool) in enumerate((("x86", 1, False), ("arm", 2, True)))]
    rows += [unit(i, "M", "/own.swift", f"/o/{v}/M.build/{i}.o", at=at) for i, v, at in ((200, "release", 3), (201, "debug", 8), (202, "release", None))]
    rows += [unit(i, "N", "/same.swift", f"/o/{v}/debug/N.build/z.o", at=at, tool=tool) for i, v, at, tool in ((210, "x86", 5, False), (211, "arm", None, True))]
    rows += [unit(i, "N", "/back.swift", f"/o/{v}/debug/N.build/z.o", at=at, tool=tool) for i, v, at, tool in ((220, "arm", 5, True), (221, "x86", None, False))]
    rows += [unit(i, "N", "/none.swift", f"/o/{v}/debug/N.build/z.o", at=None, tool=tool) for i, v, tool in ((230, "arm", True), (231, "x86", False))]
    got = {g: (r["output_file"], r["is_plugin_tool"]) for g, r in run(spark, rows).items() if g >= 200}
    arm = ("/o/arm/debug/N.build/z.o", True)
    assert got == {200: ("/o/debug/M.build/201.o", False), 210: arm, 220: arm, 230: arm}


def brute_passage(h):
    best = 0
    for a in range(len(h)):
        if not h[a]:
            continue
        miss, last = 0, False
        for b in range(a, len(h)):
            if not h[b]:
                miss += 1
                if last:
                    break
            last = not h[b]
            n = b - a + 1
            if h[b] and n - miss >= leaks.MIN_WORDS and 10 * miss < n:
                best = max(best, n)
    return best


def test_longest_passage_equals_brute_force():
    random.seed(3)
    for _ in range(1500):
        p = random.choice([0.8, 0.9, 0.95])
        h = np.array([random.random() < p for _ in range(random.randint(15, 90))])
        g = leaks.passages(h)
        assert (g[0][1] - g[0][0] if g else 0) == brute_passage(h)


def test_words():
    assert leaks.words("**Bold** <b>x</b> caf\u00e9\u200bs [l\u00adink](http://a.b/c) & a_b I'm &amp; \uff21") == ["bold", "x", "caf\u00e9s", "link", "a", "b", "i", "m", "a"]
    assert leaks.words(None) == leaks.words("") == []


def test_leaks_equal_brute_force(spark):
    random.seed(11)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [random.choice(vocab) for _ in range(n)]
    head = [f"read{i}" for i in range(18)]
    items = {i: (head if i % 2 else []) + say(40) for i in range(1, 11)}
    docs = {}
    for d in range(60):
        t = say(random.randint(0, 120))
        if d % 2:
            w = list(items[random.randint(1, 10)])
            a = random.randint(0, 15)
            part = w[a : a + random.randint(15, 45)]
            for k in range(5, len(part) - 3, random.choice([9, 12, 30])):
                part[k] = "other"
            t[len(t) // 2 : len(t) // 2] = part
        docs[d] = t
    ddf = spark.createDataFrame([(d, " *".join(t).upper(), "x") for d, t in docs.items()] + [(None, "a", ""), (999, None, ""), (5, " ".join(docs[5]), "")], "doc_id long, text string, shard string").repartition(3)
    idf = spark.createDataFrame([(i, ", ".join(w), 1) for i, w in items.items()] + [(None, "x", 0), (77, None, 0), (1, None, 0)], "item_id long, text string, term int")
    got = {(r["item_id"], r["doc_id"]): r["n_words"] for r in leaks.leaked_passages(ddf, idf).collect()}
    want = {}
    for i, w in items.items():
        own = [None if i % 2 and k < 18 else x for k, x in enumerate(w)]
        for d, t in docs.items():
            best = max((brute_passage([0 <= q + p < len(t) and own[p] is not None and own[p] == t[q + p] for p in range(len(own))]) for q in range(-len(own), len(t))), default=0)
            if best:
                want[(i, d)] = best
    assert got == want and len(want) > 5
    assert leaks.leaked_passages(ddf.limit(0), idf).count() == 0 and leaks.leaked_passages(ddf, idf.limit(0)).count() == 0


def test_items_in_blocks_give_the_same_rows(spark, monkeypatch):
    random.seed(4)
    items = [(i, " ".join(random.choice("abcdefghijklmnop") + str(random.randrange(9)) for _ in range(40))) for i in range(6)]
    docs = spark.createDataFrame([(i, "x y " + t) for i, t in items], "doc_id long, text string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leaks.leaked_passages(docs, idf).collect()}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 50)
    assert {tuple(r) for r in leaks.leaked_passages(docs, idf).collect()} == whole and len(whole) == 6


def test_spam():
    prose = "The reader opens the file and checks that it is not empty. When the file is missing, the run stops with an error.\n" * 6
    code = "import A\nfunc f(a: Int) -> Int {\n  let b = a + 1\n  return b\n}\n" * 8
    log = "".join(f"Sources/A/B{i}.swift:{i}:3: error: unused target [imports]\n" for i in range(30))
    changes = "## 1.2\n" + "".join(f"- The cache is read once for each of the {i} files. ([#{i}](https://a.example/{i}))\n" for i in range(20))
    for t in (None, "", "ok", prose, code, log, changes, prose + "#swift #code #tags\n", "Thanks!", "[One](https://a.example/1): what the first page is about and why it matters to us.\n" * 9):
        assert not spam.score(t)[-1], t
    words = "cheap kit swift course best price app builder".split()
    random.seed(1)
    stuffed = " ".join(random.choice(words) for _ in range(200))
    for t in (stuffed, "\n".join(f"- [{random.choice(words)} tool](https://x.example/{i})" for i in range(40)), " ".join(f"#{random.choice(words)}{i}" for i in range(40)), "The reader opens it. \n" + stuffed, "<ul>" + "".join(f'<li><a href="https://x.example/{i}">Best Kit</a></li>' for i in range(30)) + "</ul>", " | ".join(f"Noun{chr(97 + i % 26)} {chr(97 + i % 26)}thing" for i in range(40))):
        assert spam.score(t)[-1], t


def test_beat():
    assert spam.beat([]).recurrence == spam.beat(["a"] * 3).recurrence == 0.0
    b = spam.beat("x y z q".split() * 10)
    assert b.recurrence > 0.8 and b.regularity > 0.99 and b.periodicity > 0.5
    # Every pair of equal content words counts at its distance, as in a loop over all lags.
    random.seed(5)
    for n in (7, 60, 300):
        w = [random.choice("k l m n o p the of".split()) for _ in range(n)]
        c = [x for x in w if x not in spam.FUNCTION_WORDS]
        auto = [sum(w[k] == w[k + lag] and w[k] in c for k in range(n - lag)) / max(1, len(c) - lag) for lag in range(1, len(c) // 2 + 1)]
        assert abs(spam.beat(w).periodicity - min(1.0, max(auto) - sum(auto) / len(auto))) < 1e-9
        seen = sum(x in w[:k] for k, x in enumerate(w) if x in c)
        assert abs(spam.beat(w).recurrence - seen / len(c)) < 1e-9
    # A text beyond the lag window is measured window by window, none of it left out.
    long = [f"w{k}" for k in range(spam.WINDOW)] + ["buy", "now"] * (2 * spam.WINDOW)
    assert 0.7 < spam.beat(long).recurrence < 0.85


def test_sentences_without_listed_function_words_are_no_list():
    polish = "Wczoraj pojechaliśmy nad jezioro z całą rodziną. Woda była zimna, ale słońce mocno grzało. Dzieci zbudowały zamek z piasku i muszelek. Wieczorem rozpaliliśmy ognisko obok lasu."
    turkish = "Geçen hafta sonu ailemle birlikte göle gittik. Hava çok sıcaktı ve su berraktı. Çocuklar kumdan kaleler yaptı. Akşam yemeğinde balık pişirdik."
    for t in (polish, turkish, "我们昨天去了湖边。天气很好。孩子们在沙滩上玩。晚上我们吃了鱼。然后我们回家了。" * 2):
        assert not spam.score(t)[-1], t
    for t in ("best cheap shoes for the best cheap shoes and the cheap shoes of the best shoes in the cheap shoes shop. " * 40, "how to check the code for " * 200, "Buy our cheap shoes now. We sell the best cheap shoes and cheap shoes for you. " * 9):
        assert spam.score(t)[-1] and spam.score(t)[-2] == "repetition", t


def test_recurrence_decides(monkeypatch):
    random.seed(2)
    few = " ".join(random.choice("cheap kit swift course best price".split()) for _ in range(150))
    many = ", ".join(f"noun{chr(97 + i % 26)}{chr(97 + i // 26)} thing{chr(97 + i % 23)}" for i in range(40))
    assert spam.score(few)[-2:] == ("repetition", True) and spam.score(many)[-2:] == ("list", True)
    monkeypatch.setattr(spam, "stuffed", lambda *_: False)
    assert not spam.score(few)[-1] and spam.score(many)[-1]


def test_spam_table(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "cheap kit " * 50)], "doc_id long, text string")
    assert {r["doc_id"]: r["is_spam"] for r in spam.spam_scores(df).collect()} == {1: False, 2: False, 3: True}
    assert spam.spam_scores(df.limit(0)).count() == 0


def test_rates():
    for rate in (0.3, 1.0, 2.5):
        f = mixture.capped_mean(rate, 4)
        assert f == sorted(f) and abs(f[0] - np.exp(-rate)) < 1e-12
    bins = [(b, 10) for b in range(mixture.BINS)]
    for want in (0, 5_000, 40_960, 100_000, 10**9):
        f = mixture.set_rate(bins, 3, want)
        got = sum(n * sum((b + 0.5) / mixture.BINS >= v for v in f) for b, n in bins)
        assert abs(got - min(want, 3 * 40_960)) < 200
    a = mixture.allotted({"a": 100, "b": 10, "c": 0}, {"a": (0.5, 2), "b": (0.4, 2), "c": (0.1, 5)}, 100)
    assert a == {"a": 80.0, "b": 20.0, "c": 0.0}


def test_mix(spark):
    random.seed(2)
    words = "alpha beta gamma delta of the and with".split()
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(i, text(30), "web crawl" if i % 3 else "Web-Crawl ", "x") for i in range(900)] + [(2000 + i, text(30), "code", "x") for i in range(200)]
    rows += [(5000, rows[0][1], "code", "copy"), (5001, None, "code", ""), (5002, "", "code", ""), (5003, "t", None, ""), (5004, "t", "other", ""), (None, "t", "code", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    goal = spark.createDataFrame([("web_crawl", 0.6, 1), ("code", 0.35, 3), ("gone", 0.05, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = mixture.training_mix(docs, goal).collect()
    texts = {}
    for r in mix:
        texts.setdefault(r["text"], []).append((r["doc_id"], r["copy"]))
    cap = {d: 3 if 2000 <= d < 5000 else 1 for d in {r["doc_id"] for r in mix}}
    for copies in texts.values():
        assert len({d for d, _ in copies}) == 1 and len(copies) <= cap[copies[0][0]] and sorted(c for _, c in copies) == list(range(1, len(copies) + 1))
    assert [r["shuffle_key"] for r in mix] == sorted(r["shuffle_key"] for r in mix)
    report = {r["source"]: r for r in mixture.mix_report(docs, goal).collect()}
    assert abs(report["web_crawl"]["actual_share"] - 0.6 / 0.95) < 0.02 and report["gone"]["mix_tokens"] == 0 and not report["gone"]["target_met"]
    assert sum(r["n_tokens"] for r in mix) == sum(r["mix_tokens"] for r in report.values())
    assert mixture.training_mix(docs.limit(0), goal).count() == 0 and mixture.training_mix(docs, goal.limit(0)).count() == 0
    short = {r["source"]: r for r in mixture.mix_report(docs, goal, total_tokens=1e9).collect()}
    assert short["code"]["most_repeats"] == 3 and not short["code"]["target_met"]


def test_mix_with_repeated_rows_and_several_texts_of_one_id(spark):
    random.seed(6)
    text = lambda n: " ".join(random.choice("alpha beta gamma delta of the and with".split()) for _ in range(n))
    one, two, three = text(40), text(10), text(25)
    rows = [(1, one, "a"), (1, one, "a"), (1, one, "A "), (1, two, "a"), (2, three, "a"), (3, three, "b"), (4, text(30), "b"), (4, text(12), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    size = {t: len(mixture.encoder(mixture.TOKENIZER).encode_ordinary(t)) for _, t, _ in rows}
    for total in (None, 1e9):
        mix = mixture.training_mix(docs, goal, total_tokens=total).collect()
        assert len({(r["text"], r["copy"]) for r in mix}) == len(mix) and all(r["n_tokens"] == size[r["text"]] for r in mix)
        assert {r["doc_id"] for r in mix if r["text"] == three} <= {2}
        for r in mixture.mix_report(docs, goal, total_tokens=total).collect():
            own = [x for x in mix if x["source"] == r["source"]]
            assert (len(own), sum(x["n_tokens"] for x in own)) == (r["n_copies"], r["mix_tokens"])
            assert max((x["copy"] for x in own), default=0) == r["most_repeats"] <= {"a": 1, "b": 2}[r["source"]]
    assert {r["text"]: r["copy"] for r in mixture.training_mix(docs, goal, total_tokens=1e9).where("source = 'a'").collect()} == {one: 1, two: 1, three: 1}
