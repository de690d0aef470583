"""The pipeline keeps its contract on a small corpus, stage by stage."""

import random
import re

import corpus_pipeline
from loomtrace.llm import langid, mixing, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ich", "ver", "ö"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4)))
    prose = lambda lang, n=60: " ".join(word(lang) for _ in range(n))
    rows = [(k, prose(lang), lang, r.choice(["s1", "s2", "s3"])) for k, lang in enumerate(["en", "de"] * 100)]
    item = prose("en", 25)
    rows += [(300, rows[4][1], "en", "s1"), (301, rows[6][1] + " extra", "en", "s2"), (302, f"{prose('en')} {item} {prose('en')}", "en", "s1"), (303, f"{prose('en')} write to a.b@c.org please", "en", "s2"), (304, "123 456", "en", "s1"), (305, None, "en", "s3")]
    return [(*x, len(x[1] or "")) for x in rows], item


def test_stages_take_effect(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = lambda n: {x.doc_id for x in seen[n].select("doc_id").collect()}
    clean = set(range(200))
    assert clean <= ids("language_id") and not ids("language_id") & {304, 305}
    assert clean <= ids("jaccard_join") and not ids("jaccard_join") & {300, 301}
    assert clean <= ids("benchmark_decontamination") and 302 not in ids("benchmark_decontamination")
    text = seen["personal_data"].where("doc_id = 303").first()
    assert "[EMAIL]" in text.text and "a.b@c.org" not in text.text and text.n_chars == len(text.text)
    assert seen["personal_data"].count() == seen["benchmark_decontamination"].count()
    plan, name = mixing.plan(seen["personal_data"])
    assert seen["source_mixing"].count() == plan.selectExpr(f"sum({name}.copies) AS n").first().n
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert langid.UNKNOWN == "und"


# --------------------------------------------------------------------------- brute force
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near_duplicates(rows):
    """One of each group of rows, those equal in everything first made one."""
    rows = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    sets, up = [shingles(x[1]) for x in rows], list(range(len(rows)))
    find = lambda k: k if up[k] == k else find(up[k])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [[rows[k] for k in range(len(rows)) if find(k) == g] for g in sorted({find(k) for k in range(len(rows))})]


def plain_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = words(text)
    for item in map(words, items):
        k = min(10, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        if any(tuple(w[i : i + k]) in windows for i in range(len(w) - k + 1)):
            return True
    return False


def test_stages_match_brute_force(spark, tmp_path):
    rows, item = corpus()
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdehilnorst") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(r.choice([3, 12, 80]))) for _ in range(25)]
    for k, t in enumerate(base):
        rows.append((400 + k, t, "en", "s1", len(t)))
        for _ in range(r.randint(0, 3)):
            w = t.split()
            w[r.randrange(len(w))] = word()
            t = " ".join(w)
            rows.append((r.choice([400 + k, 500 + k, None]), t, "en", r.choice(["s1", None]), len(t)))
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "s2", 1), (None, None, None, None, None), (None, None, None, None, None), (600, "", "en", "s1", 0), (401, "quite another text than that of the other row", "en", "s1", 1)]
    rows += [(700, f"{item[:40]}", "en", "s1", 40), (701, " ".join(item.upper().split()[3:16]) + " end", "en", "s1", 1), (702, "call 555-123-4567 or a@b.org, ip 10.0.0.1", "en", "s1", 1)]
    folder = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{folder}/d")
    docs = spark.read.parquet(f"{folder}/d")
    got = [tuple(x) for x in corpus_pipeline.join_near_duplicates(spark, docs, folder).collect()]
    groups = plain_near_duplicates(rows)
    assert len(got) == len(set(got)) == len(groups)
    for g in groups:
        (kept,) = [x for x in got if x in g]
        assert kept[0] == min((x[0] for x in g if x[0] is not None), default=None)
    got = corpus_pipeline.remove_benchmark(spark, docs, folder).collect()
    assert sorted(repr(tuple(x)) for x in got) == sorted(repr(x) for x in rows if not plain_contaminated(x[1], [item]))
    field = pii.fitted()
    redacted = lambda t: pii.redact(t, pii.find_spans(t, field)[1]) if t else t
    got = corpus_pipeline.redact_personal_data(spark, docs, folder).collect()
    assert sorted(repr(x.text) for x in got) == sorted(repr(redacted(x[1])) for x in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, have = {}, {}
    for x in rows:
        have[x[3]] = have.get(x[3], 0) + size(x[1])
    for x in mixed:
        total[x.source] = total.get(x.source, 0) + size(x.text)
    # sources by code point, null last, weigh 1, 2, 3, repeating; three times a source's size at most
    names = [*sorted(x for x in have if x is not None), *([None] if None in have else [])]
    weight = {x: 1 + k % 3 for k, x in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(have.values()))
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        over = {x for x in open_ if share[x] > 3 * have[x]}
        if not over:
            target.update(share)
            break
        for x in over:
            target[x] = 3.0 * have[x]
            left -= target[x]
        open_ -= over
    for x in names:
        assert abs(total.get(x, 0) - target[x]) <= 0.02 * target[x] + 100
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, folder).count() == 0, name
