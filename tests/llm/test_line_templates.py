import re
from collections import Counter, defaultdict

import pytest
from cases import CLASHES, LONG, documents
from pyspark.sql import functions as F

from logloom.llm import line_templates as lt
from logloom.llm.catalog import LINES
from logloom.llm.line_templates import Options


def brute_force(rows, options, owner=lambda doc_id, text: doc_id):
    """(doc_id, text) to remaining texts, by the definition; ``owner`` names the class of a document."""
    def parse(line):
        tokens = re.sub(r"[ \t-\r]+", " ", line).strip(" ").split(" ")
        masked = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
        return tuple(masked if sum(t != "<*>" for t in masked) >= options.similarity * len(masked) else tokens)

    blank = lambda line: not line.strip(" \t\n\v\f\r")
    places = [(owner(d, t), parse(x)) for d, t in rows if t is not None for x in t.split("\n") if not blank(x)]
    lines = Counter(line for _, line in (set(places) if options.levels else places))
    leaves = defaultdict(list)
    for line in lines:
        leaves[len(line), line[: options.leading]].append(line)
    templates = defaultdict(set)
    for members in leaves.values():
        support = Counter()
        for m in members:
            for place in enumerate(m):
                support[place] += lines[m] if place[1] != "<*>" else 0
        for m in members:
            if options.long_tokens is not None and len(m) >= options.long_tokens and lines[m] >= options.long_documents:
                templates[m].add((m, options.long_documents))
            if sum(lines[x] for x in members) < options.min_documents:
                continue
            most = max((support[p] for p in enumerate(m)), default=0)
            levels = [options.min_documents * lt.STEP**k for k in range(20) if options.min_documents * lt.STEP**k <= most] if options.levels else [options.min_documents]
            found = set()
            for level in levels if len(members) > 1 else []:
                general = tuple(p[1] if support[p] >= level else "<*>" for p in enumerate(m))
                if sum(support[p] >= level for p in enumerate(m)) >= options.similarity * len(m):
                    found.add((general, options.min_documents))
            templates[m] |= found or {(m, options.min_documents)}
    owners = defaultdict(set)
    for who, line in places:
        for template in templates[line]:
            owners[template].add(who)
    first = {t: min((d for d in ids if d is not None), default=None) for t, ids in owners.items() if len(ids) >= t[1]}

    def goes(who, line):
        return not blank(line) and any(t in first and first[t] != who for t in templates[parse(line)])

    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if not goes(owner(d, t), x))) for d, t in rows]


def rows():
    found = []
    for n in range(60):
        lines = ["Unique " + " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + n * k % 26)}" for k in range(9))]
        if n % 2:
            lines.append("Copyright   2021 by\tthe Example Company")
        if n % 3 == 0:
            lines.append(f"Read more about topic word{'xyz'[n % 3]}{chr(97 + n % 20)} on our site today")
        if n % 5 == 0:
            lines += ["", f"{n} {n + 1} {n * 7}", "  "]
        if n % 7 == 0:
            lines.append(f"Posted on 2024-01-{n:02d} at 10:{n:02d} by the admin of site")
        found.append((n, "\n".join(lines)))
    return found


def check(spark, texts, options):
    docs = documents(spark, [(d, t, "en", "s") for d, t in texts])
    found = [(r["doc_id"], r["text"]) for r in lt.without_recurring_lines(docs, options).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_force(texts, options)))
    return dict(found)


def test_equals_brute_force(spark):
    kept = check(spark, rows(), Options())
    assert "Copyright" in kept[1] and not any("Copyright" in kept[n] for n in range(2, 60))
    assert "Posted" in kept[0] and not any("Posted" in kept[n] for n in range(1, 60))
    assert all("Unique" in t for t in kept.values())
    check(spark, rows(), Options(leading=1, similarity=0.5, min_documents=2))


@pytest.mark.parametrize("seed", range(3))
def test_levels_and_long_lines_equal_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    texts = []
    for n in range(300):
        made = [f"Posted in the {WORDS[rnd.randrange(9)]} section by {WORDS[rnd.randrange(7)]} on our public web site today"]
        made.append("Posted in the " + " ".join(rnd.choice(WORDS[:6]) for _ in range(12)))
        made.append(" ".join(WORDS[(n // 40 * k + k) % 60] for k in range(rnd.choice([49, 50, 60]))) + rnd.choice(["", " 7", " 12"]))
        texts.append((rnd.choice([n, n, n, None, n // 2]), "\n".join(rnd.sample(made, rnd.randint(0, 3)))))
    check(spark, texts, LINES)
    check(spark, texts, Options(levels=True, min_documents=3, long_tokens=8))


def test_classes_count_once_and_stay_alike(spark):
    long, other = (" ".join(WORDS[(n * n + k) % 60] for n in range(60)) for k in (1, 5))
    texts = [(1, f"{long}\nown one"), (2, f"{long}\nown one"), (3, f"{long}\nown one sea"), (4, f"{other}\nelse"), (5, f"{other}\nmore {WORDS[3]}"), (6, f"{other}\nmore {WORDS[3]}"), (None, long)]
    owner = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, None: None}
    docs = documents(spark, [(d, t, "en", "s") for d, t in texts])
    classes = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"))
    pairs = spark.createDataFrame([(d, o) for d, o in owner.items()], "_d long, component_id long")
    classes = classes.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    found = [(r["doc_id"], r["text"]) for r in lt.without_recurring_lines(docs, LINES, classes).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_force(texts, LINES, lambda d, _: owner[d])))
    kept = dict(found)
    assert kept[1] == kept[2] == texts[0][1] and kept[3] == texts[2][1] and kept[None] == ""
    assert kept[4] == texts[3][1] and kept[5] == kept[6] == f"more {WORDS[3]}"


def test_awkward_rows(spark):
    line = "The same line of seven words again"
    texts = [(n, line) for n in range(6)] + [(7, None), (8, ""), (9, " \n\t\n"), (10, f"{LONG}\n{line}"), (5, line)]
    texts += [(None, line), (None, f"x\n{line}"), (11, (line + "\n") * 2000), (12, "12 34 56"), (13, "é" * 50_000)]
    check(spark, texts, Options())
    check(spark, [(None, line)] * 3 + [(None, None)], Options(min_documents=1))


def test_columns_pass_through(spark):
    docs = documents(spark)
    found = lt.without_recurring_lines(docs)
    assert found.columns == [*docs.columns, "n_dropped"]
    assert {r[c] for r in found.collect() for c in CLASHES if c != "n_lines"} == {f"own {c}" for c in CLASHES if c != "n_lines"}


def test_empty_table(spark):
    assert lt.without_recurring_lines(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = lt.without_recurring_lines(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


WORDS = [f"{chr(97 + n % 26)}{chr(98 + n // 26)}word" for n in range(60)]


def left(spark, texts):
    docs = documents(spark, [(d, t, "en", "s") for d, t in texts])
    return {r["doc_id"]: r["text"] for r in lt.without_recurring_lines(docs, LINES).collect()}


@pytest.mark.parametrize("size", [60, 1000, 4000])
def test_the_pipeline_drops_a_template_at_any_size(spark, size):
    posted = lambda n: f"Posted in the {WORDS[n * 7 % 40]} section by {WORDS[n * 13 % 50]} on our public web site today"
    other = lambda n: "Posted in the " + " ".join(WORDS[n * k % 59] for k in range(2, 14))
    kept = left(spark, [(n, f"{posted(n)}\n{other(n)}") for n in range(size)])
    assert [n for n, text in sorted(kept.items()) if "section" in text] == [0]


def test_support_counts_documents(spark):
    texts = [(n, f"Read in the {WORDS[n]} section of our public web site") for n in range(4)]
    kept = left(spark, [*texts, (9, "\n".join([texts[0][1]] * 200))])
    assert kept == {0: texts[0][1], 1: "", 2: "", 3: "", 9: ""}


def test_the_pipeline_drops_long_lines_from_the_second_document_on(spark):
    long, short = (" ".join(WORDS[(n * n + n) % 60] for n in range(size)) for size in (50, 49))
    kept = left(spark, [(1, f"one\n{long}"), (2, f"two\n{long}\n{short}"), (3, f"three\n{short}"), (4, f"{long}\n{long}"), (5, f"five\n{long} 7")])
    assert kept == {1: f"one\n{long}", 2: f"two\n{short}", 3: f"three\n{short}", 4: "", 5: f"five\n{long} 7"}
