import corpus_pipeline as pipeline
import test_bpe
import test_linededup
import test_mixing
import test_simhash
from pairsim.llm import langid, linededup, mixing
from pairsim.sources.scratch import durable

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def brute_groups(docs):
    fps = {d: test_simhash.plain_fingerprint(t) for d, t in docs}
    roots = test_simhash.plain_groups(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], d), d)
    return set(least.values())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows_of(docs)
    profiles = langid.learn(docs)
    step = durable(pipeline.language_stage(spark, docs, SF))
    want = []
    for d, text, _, source, n in before:
        lang, score = profiles.predict(text)
        if lang != "und" and score >= pipeline.LEAST_SCORE:
            want.append((d, text, lang, source, n))
    assert sorted(rows_of(step)) == sorted(want) and len(want) == len(before)

    # What the line stage drops is compared with a brute force in test_linededup.
    gone = {r.doc_id: r.dropped for r in linededup.dropped_lines(step).collect()}
    assert all(set(v) <= set(all_gone.get(d, [])) for all_gone in [test_linededup.plain([(r[0], r[1]) for r in want])] for d, v in gone.items())
    want = [
        (d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])), lang, s)
        for d, t, lang, s, _ in want
    ]
    want = [(d, t, lang, s, len(t)) for d, t, lang, s in want]
    step = durable(pipeline.line_stage(spark, step, SF))
    assert sorted(rows_of(step)) == sorted(want)

    kept = brute_groups([(r[0], r[1]) for r in want])
    want = [r for r in want if r[0] in kept]
    step = durable(pipeline.simhash_stage(spark, step, SF))
    assert sorted(rows_of(step)) == sorted(want) and 0 < len(want) < len(before)

    mixed = mixing.mix(step).collect()
    took = test_mixing.check(mixed, [(r[0], r[3], r[1]) for r in want])
    assert abs(sum(a for a, _ in took.values()) - sum(b for _, b in took.values())) < 0.1 * sum(b for _, b in took.values())
    copies = {r.doc_id: r.copies for r in mixed}
    want = [r for r in want for _ in range(copies[r[0]])]
    step = durable(pipeline.mixing_stage(spark, step, SF))
    assert sorted(rows_of(step)) == sorted(want)

    out = pipeline.bpe_stage(spark, step, SF).collect()
    encode = lambda t: test_bpe.THEIRS.encode(t, add_special_tokens=False).ids
    assert sorted((r.doc_id, tuple(r.ids)) for r in out) == sorted((r[0], tuple(encode(r[1]))) for r in want)
    assert sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_odd_rows(spark):
    text = "the and of that with from"
    docs = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " x", "en", None, 1), (None, text + " x", "en", None, 1),
            (2, None, "en", "a", 0), (3, "", "en", "b", 0), (4, "12 34", None, "b", 5), (5, "漢字 漢字", None, "b", 5)]
    df = spark.createDataFrame(docs, FIELDS).selectExpr("*", "7 as fp", "8 as place", "9 as score")
    counts, steps = [], df
    for i, (_, stage) in enumerate(pipeline.STAGES):
        steps = durable(stage(spark, steps, SF))
        assert i == 4 or steps.columns == pipeline.COLUMNS
        counts.append(steps.count())
    assert counts[:3] == [4, 4, 2]
    # A row that shares only its id with a copy stays.
    rows = [(3, text, "en", "a", 1), (5, text, "en", "a", 1), (5, "other words than those here at all", "en", "a", 1)]
    out = pipeline.simhash_stage(spark, spark.createDataFrame(rows, FIELDS), SF).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(3, text), (5, rows[2][1])]
    steps = spark.createDataFrame([], FIELDS)
    for _, stage in pipeline.STAGES:
        steps = durable(stage(spark, steps, SF))
        assert steps.count() == 0
