import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import leak, packing, residue
from weirflow.llm import residue_text
from weirflow.llm.residue_rules import has_slot


def test_packing_is_feasible_and_tight():
    rnd = random.Random(1)
    for capacity, separator in ((100, 0), (100, 1), (64, 3)):
        for n in (0, 1, 2, 50, 400):
            sizes = sorted((min(capacity, max(1, int(rnd.expovariate(1 / 30)))) for _ in range(n)), reverse=True)
            got = packing.pack(sizes, capacity, separator)
            assert sorted(i for c in got for i in c) == list(range(n))
            assert all(sum(sizes[i] for i in c) + separator * (len(c) - 1) <= capacity for c in got)
            bound = packing.lower_bound([s + separator for s in sizes], capacity + separator) if n else 0
            assert len(got) <= 2 + 1.06 * bound
    assert len(packing.pack([60] * 10, 100, 0)) == 10 and len(packing.pack([50] * 10, 100, 0)) == 5 and len(packing.pack([100], 100, 5)) == 1


def test_differencing_balances():
    rnd = random.Random(2)
    sizes = sorted((rnd.randrange(1, 1000) for _ in range(500)), reverse=True)
    parts = packing.difference(sizes, 7)
    assert sorted(i for _, p in parts for i in p) == list(range(500)) and max(s for s, _ in parts) - min(s for s, _ in parts) <= 5
    assert packing.difference([], 3) == []


def test_packed_documents(spark):
    texts = {1: "a b c", 2: "word " * 700, 3: None, 4: "   ", 5: "ünï " * 40, 6: "x"}
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(6, "x", "again"), (None, "no id", "z")], "doc_id bigint, text string, n_tokens string").repartition(2)
    rows = packing.pack_documents(docs, [(1, 64, 1), (2, 4096, 2)], pool=3).collect()
    enc = packing.tokenizer(f"{packing.TOKENIZERS}/{packing.TOKENIZER}")
    for b, cap, sep in ((1, 64, 1), (2, 4096, 2)):
        mine = [r for r in rows if r["budget_id"] == b]
        per = {}
        for r in mine:
            per.setdefault(r["container_id"], []).append(r)
        for c in per.values():
            assert sum(r["n_tokens"] for r in c) + sep * (len(c) - 1) == c[0]["container_tokens"] <= cap
        for i in (1, 2, 5):
            pieces = sorted((r["piece"], r["start_token"], r["n_tokens"]) for r in mine if r["doc_id"] == i)
            n = len(enc.encode_ordinary(texts[i]))
            assert sum(p[2] for p in pieces) == n and len(pieces) == max(1, -(-n // cap)) and [p[1] for p in pieces] == [k * cap for k in range(len(pieces))]
        assert {r["doc_id"] for r in mine} == {1, 2, 5, 6, None} and len([r for r in mine if r["doc_id"] == 6]) == 2
    assert packing.pack_documents(docs.limit(0), [(1, 64, 1)]).count() == 0 and packing.pack_documents(docs, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, [(1, 0, 1)])


def test_packing_follows_from_the_documents_alone(spark):
    """Same containers for 3 and 30 partitions, in another order, though a third of the rows are one row repeated."""
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(-(2**62), 2**62), min(900, int(rnd.expovariate(1 / 120)) + 1)) for i in range(600)] + [(7, 7, 40)] * 300
    want = None
    for parts in (3, 30):
        rnd.shuffle(rows)
        sizes = spark.createDataFrame(rows, "doc_id bigint, h bigint, n bigint").repartition(parts)
        got = packing.pack_sizes(sizes, [(1, 512, 1), (2, 2048, 1)], pool=150)
        got = sorted(map(tuple, got.collect()))
        assert want is None or got == want
        want = got
    assert len([r for r in want if r[0] == 1 and r[2] == 7]) == 301


WORDS = [a + b for a in ("kol", "mar", "tes", "vun", "rip", "dax", "hol", "pem") for b in ("a", "ento", "ix", "ur", "isk", "ode", "alt", "ny", "um", "ere")]


def passage(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def noisy(rnd, words):
    out = []
    for w in words:
        x = rnd.random()
        out += [] if x < 0.03 else [w[:-1] + "q"] if x < 0.07 else [rnd.choice(WORDS)] if x < 0.09 else [w.upper() if x < 0.2 else w]
    return out


def test_leaks_found_and_nothing_else(spark):
    rnd = random.Random(8)
    items = [(i, passage(rnd, rnd.randrange(24, 120))) for i in range(80)]
    filler = lambda n: [rnd.choice(("the", "of", "service", "timer", "runs", "every", "night", "until", "done")) for _ in range(n)]
    docs, truth = [], set()
    for n in range(240):
        i, p = items[n % 80]
        kind = n % 6
        if kind == 0:
            body = noisy(rnd, p)
        elif kind == 1:  # rather more than half, in two stretches with text between
            h = max(9, int(len(p) * 0.33))
            body = noisy(rnd, p[:h]) + filler(30) + noisy(rnd, p[-h:])
        elif kind == 2:
            body = ["<b>" + w + "</b>" if k % 5 else w[:2] + "​" + w[2:] for k, w in enumerate(p)]
        elif kind == 3:
            body = rnd.sample(p, len(p))  # the vocabulary alone
        elif kind == 4:
            body = p[:6]  # a short phrase
        else:
            body = []
        if kind < 3:
            truth.add((n, i))
        docs.append((n, " ".join(filler(rnd.randrange(200)) + body + filler(rnd.randrange(200)))))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1] * 30)), (902, " ".join(items[3][1]))]
    truth |= {(902, 3)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    tests = spark.createDataFrame([(i, " ".join(p).capitalize() + ".") for i, p in items] + [(500, None), (501, " "), (502, "one two three"), (503, " ".join(items[3][1]))], "item_id bigint, passage string").withColumn("text", F.lit(1))
    truth |= {(d, 503) for d, i in truth if i == 3}
    got = [(r["doc_id"], r["item_id"]) for r in leak.leaked(df, tests, share=0.42).collect()]
    missed = truth - set(got)
    assert not set(got) - truth and len(missed) <= 0.05 * len(truth), missed
    assert len([g for g in got if g == (902, 3)]) == 2  # repeated documents, a row each
    blocks = leak.leaked(df, tests, block_words=700)
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == sorted(got)
    assert leak.leaked(spark.createDataFrame([(1, "it is one, two: THREE of them")], "doc_id bigint, text string"), tests).collect()[0]["item_id"] == 502
    assert leak.leaked(df.limit(0), tests).count() == 0 and leak.leaked(df, tests.limit(0)).count() == 0


def test_recall_by_length_and_edits():
    """Passages of every length with one word edited, and long ones with more, are found again; other texts are not."""
    rnd = random.Random(12)
    vocabulary = WORDS + [w + "s" for w in WORDS] + [w + "ed" for w in WORDS]
    for n, edits in [(5, 0), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 1), (11, 1), (12, 1), (14, 2), (24, 3), (60, 8), (140, 20)]:
        items = [(i, [rnd.choice(vocabulary) for _ in range(n)]) for i in range(80)]
        searches = leak.searches([(i, " ".join(p)) for i, p in items], leak.SHARE)
        texts = []
        for _, p in items:
            q = p[:]
            for k in rnd.sample(range(n), edits):
                q[k] = rnd.choice(["quux", rnd.choice(vocabulary), ""])
            texts.append(" ".join(["before", "it"] + q + ["after", "it"]))
        found = {f[:2] for search in searches for f in search(texts)}
        right = sum((i, i) in found for i in range(80))
        assert right >= 72, (n, edits, right)
        assert len(found) - right <= 2, (n, edits, found)


def test_banded_alignment():
    rnd = random.Random(2)
    for _ in range(200):
        x = [rnd.randrange(9) for _ in range(rnd.randrange(1, 30))]
        y = x[:]
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(y) + 1)
            y[k : k + rnd.randrange(2)] = [rnd.randrange(9)] * rnd.randrange(2)
        edits, kept = leak.aligned(x, y)
        full = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                full[i][j] = i + j if not i or not j else min(full[i - 1][j - 1] + (x[i - 1] != y[j - 1]), full[i - 1][j] + 1, full[i][j - 1] + 1)
        assert edits == full[-1][-1] and len(kept) >= len(x) - edits


def test_close_windows_meet():
    """Windows within one edit meet in some repetition far more often than windows that share nothing."""
    rnd = random.Random(3)
    p = passage(rnd, 400)
    index = leak.Index([(1, " ".join(p))])
    ids = index.passages[0]
    met = apart = 0
    for s in range(0, 380, 4):
        w = ids[s : s + leak.WINDOW].copy()
        w[rnd.randrange(leak.WINDOW)] = 0
        met += len(index.candidates(w, np.array([0]))[0]) > 0
        other = np.array([rnd.randrange(len(WORDS)) + 1 for _ in range(leak.WINDOW)], np.int32)
        apart += len(index.candidates(other, np.array([0]))[0]) > 0
    assert met >= 80 and apart <= 10


SLOTS = ["Dear {{ name }}, welcome.", "Your run ended at ${release_date} today.", "We closed <no value> tickets.", "It took %!s(MISSING) attempts.", "Hi [insert team name], see below.", "The __service__ moved.", "Moved on XXXXX to the new place.",
         "The *** version number *** is out.", "See <%= link %> for more.", "Hello _______, thanks.", "the [object Object] team", "Nobody saw the undefined again.", "Call @@tenant@@ now.", "Sent to %(owner)s by mail.", "* Nobody fenced the ledger ${STARTTIME} 19:40.", "We agree on it *** YOUR COMPONENT HERE *** today.", "Ihr Lauf %s endete."]
CLEAN = ["Use `{{ name }}` in the template.", 'It printed "<no value>" once.', "```\nexport A=${HOME}/x\n```\nThat sets the path.", "The linter flags templates with leftovers such as [insert team name] or TODO.", "The path is /v1/x/{id}/steps/{step} and both are checked.",
         "Behaviour for a nil mesh is undefined in the old client.", "> Please enable JavaScript\n\nThat banner came from the old console, which we deleted last week together with its pages.", "20:30:59 level=info err=<nil>", 'log.Printf("canal %s took %v", in.ID)', "What??? Really.", "",
         'Clients saw a plain "404 Not Found" for 58 minutes because the router had lost its table.', "The dashboard draws its graph with JavaScript, and people who disable scripts get the table view."]


def test_residue_rules():
    assert [t for t in SLOTS if not has_slot(t)] == []
    assert [t for t in CLEAN if has_slot(t)] == []


def reasons(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit("clash")).withColumn("label", F.lit("body")).repartition(3)
    return {r["doc_id"]: r["reason"] for r in residue.residue(df).collect()}


def segments(text):
    return [s for s, n, _ in residue_text.read(text, residue_text.masks(), residue_text.kinds()) if n]


def test_masked_segments():
    assert segments("Run 17 of pallet-probe took 3.5ms.\n# Heading\nPlease enable client-side scripts!") == ["run 0 of § took §", "please enable js"]
    assert segments("<p>Please enable JavaScript</p><p>Error 404</p>") == ["please enable js", "error 0"]
    assert segments("Lorem ipsum dolor sit amet. Vitae mollis ligula rutrum.") == ["lat", "lat"] and segments("blah blah blah blah blah") == ["rep"] and segments("sdfkj lkjsdf jjkl dfs") == ["key"]
    assert segments('He said "page not found" twice.\n> access denied') == ["", ""]
    assert segments("We put your type in.") == ["we put your type in"] and segments("It is minimal in its ad.") != ["lat"]


def test_labels_spread_over_shared_segments(spark):
    """From two trusted notices to others, to a menu, and to a text that runs its segments together; not to content."""
    rnd = random.Random(4)
    menu, other, third = "Runs Graphs Help", "The gateway had a bad day", "Come back in a while"
    river = " ".join(rnd.choice(["river", "stone", "cloud", "tree", "wind"]) for _ in range(60))
    docs = [(1, f"Access denied.\n{menu}"), (2, f"404 not found\n{menu}\n{other}"), (3, f"{other}.\n{menu}"), (4, f"{third}\n{other}"), (5, f"{other}\n{third}\n{menu}"), (6, third), (7, f"{third} {other} {menu}")]
    # content that quotes, discusses or shares a line with them
    docs += [(20, f"{river}\n404 not found\n{menu}"), (21, f'The page said "{other}" and "{third}", which we then changed for something that says what happened to whom.'), (22, river), (23, f"{river}\n{third}"), (24, "Short note.")]
    got = reasons(spark, docs)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[6] == "spread"
    # without the trusted two nothing is known
    assert reasons(spark, [d for d in docs if d[0] not in (1, 2, 20)]) == {}


def test_bodies(spark):
    trusted = ["404 Not Found", "Please enable JavaScript to view this page.", "<html><body><h1>500 - Internal Server Error</h1></body></html>", "Lorem ipsum dolor sit amet. Consectetur adipiscing elit sed do eiusmod.", "blah blah blah blah blah blah blah blah", "jafdld hdd hsjfk ffk", "Accès refusé."]
    got = reasons(spark, list(enumerate(trusted)) + [(100 + i, t) for i, t in enumerate(CLEAN)] + [(200, "17 18 19"), (201, "...")])
    assert got == {i: "seed" for i in range(len(trusted))}


def test_residue_spreads_to_near_duplicates_only(spark):
    rnd = random.Random(6)
    known = "Access denied.\n" + " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(30))
    far = " ".join(rnd.choice(["river", "stone", "cloud", "tree", "wind"]) for _ in range(120))
    content = "The shard is drained. " * 3 + " ".join(rnd.choice(["river", "stone", "cloud"]) for _ in range(60))
    docs = [(1, known), (2, known), (6, far), (7, content + " {{ name }} "), (8, content + " Anna "), (9, None), (10, " \n"), (11, "x"), (12, "404 not found")] + [(100 + i, far) for i in range(50)]
    got = reasons(spark, docs)
    assert got[7] == "slot" and 8 not in got and got[12] == "seed" and not set(got) & {6, 9, 10, 11, 100} and {1, 2} <= set(got)
    assert residue.residue(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_near_duplicates_of_residue(spark):
    """A chain of revisions of a residue text, each a near-duplicate of the one before, is reached link by link."""
    rnd = random.Random(3)
    notices = " ".join(f"access denied {rnd.choice(WORDS)} {rnd.choice(WORDS)} {rnd.choice(WORDS)}." for _ in range(60))
    steps, words = [notices], notices.split()
    for k in range(4):
        words = words[:]
        for j in range(4):
            at = 5 * (13 * k + 3 * j)
            words[at : at + 2] = ["quux", "yonder"]
        steps.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(steps)) + [(9, " ".join(rnd.choice(WORDS) for _ in range(300)))], "doc_id bigint, text string")
    nodes = residue.signed(rows).select("key", F.col("doc_id").alias("rep"), *residue.CUTS, "shingles").cache()
    near, rest = residue.reached(nodes.where("rep > 0"), nodes.where("rep = 0"), rows)
    assert {r["rep"] for r in near.collect()} == {1, 2, 3, 4} and {r["rep"] for r in rest.collect()} == {9}
    direct = residue.linked(residue.near_pairs(nodes.where("rep > 0"), nodes.where("rep = 0")), rows)
    assert 4 not in {r["hit"] for r in direct.collect()}


def test_near_pairs_and_likeness(spark):
    """Links between a set of unlabelled and a set of labelled texts, against all pairs."""
    rnd = random.Random(9)
    base = [" ".join(rnd.choice(WORDS) for _ in range(150)) for _ in range(12)]
    texts = []
    for n in range(60):
        w = base[n % 12].split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(150)] = rnd.choice(WORDS)
        texts.append(" ".join(w))
    sets = [set(residue.shingle_hashes(t.split(), residue.word_hashes()).tolist()) for t in texts]
    nodes = spark.createDataFrame([(i, *residue.simhash(np.unique(residue.shingle_hashes(t.split(), residue.word_hashes()))), len(sets[i])) for i, t in enumerate(texts)], "rep bigint, sig bigint, turned bigint, mixed bigint, shingles int")
    distinct = [np.unique(residue.shingle_hashes(t.split(), residue.word_hashes())) for t in texts]
    assert residue.simhashes(distinct) == [residue.simhash(x) for x in distinct] and residue.simhashes([]) == []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs = residue.near_pairs(nodes.where("rep < 30"), nodes.where("rep >= 30"))
    got = {(r["a"], r["b"]) for r in residue.alike(pairs, docs).collect()}
    for nearest in (0, 1, 16):
        assert {r["hit"] for r in residue.linked(pairs, docs, nearest).collect()} == {a for a, _ in got}
    want = {(a, b) for a in range(30) for b in range(30, 60) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_very_long_texts_take_linear_time():
    import time

    rnd = random.Random(1)
    for text in ("{{ x }};" * 50_000 + "{", "word " * 400_000, "a" * 1_000_000, "`{{ x }}` " * 50_000, "<" * 300_000, "```\n" * 50_000, "404 not found " * 50_000 + "river stone " * 200_000, " ".join(rnd.choice(WORDS) for _ in range(300_000))):
        began = time.time()
        has_slot(text)
        residue_text.read(text, residue_text.masks(), residue_text.kinds())
        residue.simhash(np.unique(residue.shingle_hashes(text.lower().split(), residue.word_hashes())))
        leak.words(text)
        assert time.time() - began < 20
    p = passage(rnd, 60)
    index = leak.Index([(1, " ".join(p))])
    found = leak._search(index, 0.42)([" ".join(p * 2000), " ".join(rnd.choice(WORDS) for _ in range(100_000)) + " " + " ".join(p)])
    assert [f[:2] for f in found] == [(0, 1), (1, 1)]
    enc = packing.tokenizer(f"{packing.TOKENIZERS}/{packing.TOKENIZER}")
    assert len(enc.encode_ordinary("a" * 200_000)) > 1000
