import random

from pyspark.sql import functions as F

from plumbgauge.llm import line_dedup
from tests.llm.conftest import COLUMNS

K, MIN = 12, 24


def plain(rows, similarity=0.8):
    """Text per row after removal, by all pairs of lines; rows in order of doc_id, all different."""
    def cutoff(line):
        return line.strip(" \t\r")
    occurrences, sets = [], {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            line = cutoff(line)
            if len(line) >= MIN:
                occurrences.append((doc, no, line))
                sets[line] = {line[i:i + K] for i in range(len(line) - K + 1)}
    every = list(sets)
    root = {line: line for line in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(every):
        for b in every[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    seen, gone = set(), set()
    for doc, no, line in occurrences:
        if find(line) in seen:
            gone.add((doc, no))
        seen.add(find(line))
    return {doc: None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if (doc, no) not in gone) for doc, text in rows}


def test_equals_all_pairs_on_the_table(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == plain(rows)


def test_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(40):  # each differs from the next by one word, the ends differ in many
        rows.append((i, "\n".join([" ".join(words), f"own line number {i} {rng.random()} {rng.random()}"]), "en", "s", 1))
        words[rng.randrange(60)] = "".join(rng.choice("abcdefghij") for _ in range(6))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert got == plain([(r[0], r[1]) for r in rows])


def test_a_changed_character_is_found_at_any_length_and_without_blanks(spark):
    rng = random.Random(2)
    rows, kinds = [], ["5 words", "8 words", "20 words", "no blanks"]
    for kind in kinds:
        for _ in range(100):
            if kind == "no blanks":
                line = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(60))
            else:
                line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(int(kind.split()[0])))
                line = line.ljust(40, "q")
            rows += [(len(rows), line), (len(rows) + 1, line[:-1] + "!"), (len(rows) + 2, line + ".")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS)).collect()}
    wanted = plain(rows)
    for i in range(len(kinds)):
        gone = [doc for doc, text in wanted.items() if doc // 300 == i and text == ""]
        assert len(gone) == 200
        assert sum(got[doc] == "" for doc in gone) >= 0.97 * len(gone), kinds[i]
    assert all(got[doc] == text for doc, text in wanted.items() if text)


def test_odd_rows(edge):
    out = line_dedup.dedup(edge)
    assert out.columns == [*edge.columns, "n_lines_dropped"]
    rows = out.select("doc_id", "text", "n_lines_dropped").collect()
    assert len(rows) == edge.count()
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (2, None)}
    assert texts[3] is None and texts[7] is None and texts[4] == "" and texts[5] == " \t\n "
    assert [r["n_lines_dropped"] for r in rows if r["doc_id"] == 1] == [0]
    assert [r["text"] for r in rows if r["doc_id"] == 2] == ["", ""]
    assert texts[9] == texts[9] and "second line" not in texts[9]


def test_empty_table(empty):
    assert line_dedup.dedup(empty).count() == 0


def test_plan_has_no_python(docs):
    plan = line_dedup.dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_signatures_hash_a_shingle_once_and_hold_the_recall_of_the_bands(spark):
    rng = random.Random(5)

    def letters(n):
        return "".join(rng.choice("abcdefghij😀é") for _ in range(n))
    rows = []
    for i in range(1500):  # 51 shingles each, 45 in common: 0.79; 46: 0.82
        line = letters(62)
        rows += [(2 * i, line), (2 * i + 1, line[:57] + letters(5))]
    found = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", MIN)
    signed = line_dedup.signatures(found, K)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("min(") <= 2 * line_dedup.BANDS * line_dedup.ROWS
    keys = {r["lid"]: set(r["keys"]) for r in signed.collect()}
    pairs = {}
    for r in found.select("_doc", "_lid").collect():
        pairs.setdefault(r["_doc"] // 2, []).append(keys[r["_lid"]])
    assert sum(bool(a & b) for a, b in pairs.values()) >= 0.97 * len(pairs)


def test_shingles_are_those_of_code_points(spark):
    line = "a😀é" * 9 + "x" * 7
    got = spark.createDataFrame([(line,), ("short",)], "line string").select("line", F.size(line_dedup._shingles(F.col("line"), K)).alias("n")).collect()
    assert {r["line"]: r["n"] for r in got} == {line: len({line[i:i + K] for i in range(len(line) - K + 1)}), "short": 1}
