"""DuckDB SQL for the registered queries, assembled from named parts."""

from __future__ import annotations

import re

from pairsim.plans.tables import SEED

PARTS: dict[str, str] = {}
ORDER: list[str] = []


def part(name: str, sql: str) -> None:
    PARTS[name] = sql
    ORDER.append(name)


def with_parts(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named parts (already in dependency order) and the body."""
    ctes = ", ".join(f"{n} AS ({PARTS[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


def h(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def u(*parts: str) -> str:
    return f"(('0x' || substr({h(*parts)}, 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def idx(size: str, *parts: str) -> str:
    return f"floor({u(*parts)} * ({size}))::INT"


def word_list(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def clean(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'))"


def grams(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i, {n})))"


def jaccard(a: str, b: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {i})"
    return f"CASE WHEN {union} > 0 THEN {i}::DOUBLE / {union} ELSE 0.0::DOUBLE END"


def ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN greatest(length({a}), length({b})) > 0 THEN "
        f"least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) "
        f"ELSE 1.0::DOUBLE END"
    )


def pearson(p: str, y: str) -> str:
    """Moment form; NaN where a variance is zero."""
    return (
        f"CASE WHEN count({p}) = 0 THEN NULL WHEN stddev_pop({p}) * stddev_pop({y}) = 0 "
        f"THEN 'nan'::DOUBLE ELSE covar_pop({p}, {y}) / (stddev_pop({p}) * stddev_pop({y})) END"
    )


def finish(p: str) -> str:
    r = f"round_even(({p})::FLOAT::DOUBLE, 1)"
    return f"CASE WHEN isnan({p}) THEN {p} WHEN {r} < 0 THEN 0.0 WHEN {r} > 5 THEN 5.0 ELSE {r} END"


def huber(p: str, y: str) -> str:
    e = f"abs({p} - {y})"
    return f"avg(CASE WHEN {e} <= 1 THEN 0.5 * {e} * {e} ELSE {e} - 0.5 END)"


def metric_columns(p: str, y: str, digits: int = 6) -> str:
    r = pearson(p, y)
    return (
        f"count(*) AS n, round({r}, {digits}) AS pearson, round(avg(abs({p} - {y})), {digits}) AS loss_l1, "
        f"round(avg(({p} - {y}) * ({p} - {y})), {digits}) AS loss_mse, round({huber(p, y)}, {digits}) AS loss_huber, "
        f"round(1 - ({r}) * ({r}), {digits}) AS loss_plcc"
    )


# ---- tables -----------------------------------------------------------------

part("doc_lines", "SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents")
part("lines", "SELECT concat(doc_id, '-', i - 1) AS id, doc_id, i - 1 AS line_no, source, lang, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM doc_lines)")
part("line_pairs", "SELECT concat(doc_id, '-', i - 1) AS id, doc_id, i - 1 AS line_no, source, lang, ls[i] AS sentence_1, ls[i + 1] AS sentence_2 FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM doc_lines)")
part("turn_pairs", "SELECT concat(a.conv_id, '-', a.turn) AS id, a.role AS source, a.text AS sentence_1, b.text AS sentence_2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
part("drawn", f"SELECT *, CASE WHEN {u(str(SEED), chr(39)+'zero'+chr(39), 'id')} < 0.55 THEN 0.0::DOUBLE ELSE floor({u(str(SEED), chr(39)+'label'+chr(39), 'id')} * 51) / 10.0::DOUBLE END AS label FROM line_pairs")
part("labelled", 'SELECT id, source, sentence_1, sentence_2, label, CASE WHEN label >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "binary-label" FROM drawn')
part("swapped", "SELECT id, source, sentence_1, sentence_2, label, \"binary-label\", 'orig' AS variant FROM labelled UNION ALL SELECT id, source, sentence_2, sentence_1, label, \"binary-label\", 'swap' FROM labelled")
part("cleaned", f"SELECT id, doc_id, line_no, source, lang, {clean('sentence_1')} AS a, {clean('sentence_2')} AS b FROM line_pairs")
part("cleaned_sets", f"SELECT *, list_distinct({word_list('a')}) AS wa, list_distinct({word_list('b')}) AS wb FROM cleaned")
part("gram_sets", f"SELECT *, {grams('a', 2)} AS a2, {grams('b', 2)} AS b2, {grams('a', 3)} AS a3, {grams('b', 3)} AS b3 FROM cleaned_sets")
part("scored", f"SELECT id, doc_id, line_no, source, lang, round_even(5 * ({jaccard('wa', 'wb')}), 1) AS label, 5 * ({jaccard('a3', 'b3')}) AS prediction FROM gram_sets")
part("three", f"SELECT id, unnest(['char2', 'char3', 'length']) AS model, unnest([5 * ({jaccard('a2', 'b2')}), 5 * ({jaccard('a3', 'b3')}), 5 * ({ratio('a', 'b')})]) AS prediction FROM gram_sets")
part("line_words", f"SELECT unnest({word_list('text')}) AS word FROM lines")
part("blocks", f"SELECT *, (r - 1) // 6 AS block FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS r FROM (SELECT word, count(*) AS n FROM line_words GROUP BY word) WHERE {u(str(SEED), chr(39)+'entry'+chr(39), 'word')} < 0.5)")
part("synonyms", "SELECT a.word, list(b.word ORDER BY b.r) AS synonyms FROM blocks a JOIN blocks b ON a.block = b.block AND a.word <> b.word GROUP BY a.word")
part("back_texts", f"SELECT DISTINCT text, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS back_text FROM lines WHERE {u(str(SEED), chr(39)+'back'+chr(39), 'text')} >= 0.1")
part("history", "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value FROM events")
part("backed", "SELECT p.*, x.back_text AS back_1, y.back_text AS back_2 FROM line_pairs p LEFT JOIN back_texts x ON p.sentence_1 = x.text LEFT JOIN back_texts y ON p.sentence_2 = y.text")
part("placed", "SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos, count(*) OVER () AS total FROM line_pairs")
part("place_split", "SELECT *, CASE WHEN pos < trunc(total * 0.7::DOUBLE) THEN 'train' WHEN pos < trunc(total * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM placed")

S = str(SEED)


def q(s: str) -> str:
    return f"'{s}'"


def split_by_id(source: str) -> str:
    return (
        "SELECT *, CASE WHEN pos < trunc(total * 0.7::DOUBLE) THEN 'train' WHEN pos < trunc(total * 0.85::DOUBLE) "
        "THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, "
        f"count(*) OVER () AS total FROM {source})"
    )


part("id_split", split_by_id("labelled"))


# ---- balancing ----------------------------------------------------------------


def balance_parts(source: str, tag: str) -> None:
    """Parts ``{tag}_balanced`` from a table with the pair columns and ``variant``."""
    values = 'id, source, sentence_1, sentence_2, label, "binary-label"'
    part(f"{tag}_zeros", f"SELECT *, row_number() OVER (ORDER BY {h(S, q('keep'), 'id', 'variant')}, id, variant) - 1 AS r, count(*) OVER () AS total FROM {source} WHERE label = 0")
    part(f"{tag}_marked", f"SELECT *, r < round_even(total * 0.5::DOUBLE, 0) AS kept FROM {tag}_zeros")
    part(f"{tag}_removed", f"SELECT {values}, min(variant) AS variant FROM {tag}_marked GROUP BY {values} HAVING count(*) = 1 AND NOT bool_or(kept)")
    part(f"{tag}_second", f"SELECT *, row_number() OVER (ORDER BY {h(S, q('relabel'), 'id', 'variant')}, id, variant) - 1 AS r, count(*) OVER () AS total FROM {tag}_removed")
    part(
        f"{tag}_balanced",
        f"SELECT {values}, variant, 'kept' AS role FROM {tag}_marked WHERE kept "
        f"UNION ALL SELECT id, source, sentence_1, sentence_1, 5.0::DOUBLE, 1.0::DOUBLE, variant, 'relabelled' FROM {tag}_second WHERE r < round_even(total * 0.5::DOUBLE, 0) "
        f"UNION ALL SELECT {values}, variant, 'other' FROM {source} WHERE label IS DISTINCT FROM 0",
    )


def balance_names(tag: str) -> str:
    return f"{tag}_zeros {tag}_marked {tag}_removed {tag}_second {tag}_balanced"


balance_parts("swapped", "all")
part("clean_split", f'SELECT id, source, {clean("sentence_1")} AS sentence_1, {clean("sentence_2")} AS sentence_2, label, "binary-label", split FROM id_split')
part("train_swapped", "SELECT id, source, sentence_1, sentence_2, label, \"binary-label\", 'orig' AS variant FROM clean_split WHERE split = 'train' UNION ALL SELECT id, source, sentence_2, sentence_1, label, \"binary-label\", 'swap' FROM clean_split WHERE split = 'train'")
balance_parts("train_swapped", "train")


# ---- word edits ---------------------------------------------------------------
# Each edit takes a part with (k, ws): row key and word list, and gives (k, v, out).


def edit_parts(source: str, tag: str, variants: int, only: str | None = None) -> str:
    """Parts of the edits over ``source``; returns their names in order."""
    names = []

    def add(name: str, sql: str) -> None:
        part(f"{tag}_{name}", sql)
        names.append(f"{tag}_{name}")

    def seeded(edit: str, *rest: str) -> tuple[str, ...]:
        return (S, "k", "v", q(edit), *rest)

    vs = f"(SELECT unnest(range({variants})) AS v)"
    add("base", f"SELECT k, v, ws, len(ws) AS size, greatest(1, floor(len(ws) * 0.1::DOUBLE)::INT) AS n FROM {source} CROSS JOIN {vs}")
    base = f"{tag}_base"
    if only in (None, "replace"):
        add("distinct", f"SELECT DISTINCT k, v, n, unnest(ws) AS w FROM {base}")
        add("known", f"SELECT d.*, s.synonyms, row_number() OVER (PARTITION BY k, v ORDER BY {h(*seeded('replace', q('order'), 'w'))}, w) AS i FROM {tag}_distinct d JOIN synonyms s ON d.w = s.word")
        add("chosen", f"SELECT k, v, w, i, synonyms[{idx('len(synonyms)', *seeded('replace', q('pick'), 'w'))} + 1] AS z FROM {tag}_known WHERE i <= n")
        add("steps_r", f"SELECT k, v, 0::BIGINT AS i, ws FROM {base} UNION ALL SELECT r.k, r.v, c.i, list_transform(r.ws, lambda x: CASE WHEN x = c.w THEN c.z ELSE x END) FROM {tag}_steps_r r JOIN {tag}_chosen c ON c.k = r.k AND c.v = r.v AND c.i = r.i + 1")
        add("replace", f"SELECT k, v, array_to_string(arg_max(ws, i), ' ') AS out FROM {tag}_steps_r GROUP BY k, v")
    if only in (None, "insert"):
        tries = (
            f"SELECT r.*, t, r.ws[{idx('len(r.ws)', *[x if x not in ('k', 'v') else 'r.' + x for x in seeded('insert', q('word'), 'r.i', 't')])} + 1] AS w "
            f"FROM {tag}_steps_i r CROSS JOIN (SELECT unnest(range(9)) AS t) WHERE r.i < r.n AND len(r.ws) > 0"
        )
        place = idx("len(any_value(ws))", "any_value(" + S + ")", "k", "v", q("insert"), q("place"), "i")
        add(
            "steps_i",
            f"SELECT k, v, 0 AS i, n, ws FROM {base} UNION ALL SELECT k, v, i + 1, n, "
            f"CASE WHEN s IS NULL THEN ws ELSE ws[1:p] || [s] || ws[p + 1:] END FROM ("
            f"SELECT k, v, i, n, any_value(ws) AS ws, arg_min(synonyms[1], t) FILTER (WHERE synonyms IS NOT NULL) AS s, {place} AS p "
            f"FROM ({tries}) x LEFT JOIN synonyms y ON y.word = x.w GROUP BY k, v, i, n)",
        )
        add("insert", f"SELECT k, v, array_to_string(arg_max(ws, i), ' ') AS out FROM {tag}_steps_i GROUP BY k, v")
    if only in (None, "swap"):
        a = idx("size", *seeded("swap", q("first"), "i"))
        bs = ", ".join(idx("size", *seeded("swap", q("second"), "i", str(j))) for j in range(3))
        add(
            "steps_s",
            f"SELECT k, v, 0 AS i, n, size, ws FROM {base} UNION ALL SELECT k, v, i + 1, n, size, "
            f"CASE WHEN b IS NULL THEN ws ELSE list_transform(ws, lambda x, j: CASE WHEN j = a + 1 THEN ws[b + 1] WHEN j = b + 1 THEN ws[a + 1] ELSE x END) END "
            f"FROM (SELECT *, list_filter(bs, lambda x: x <> a)[1] AS b FROM (SELECT *, {a} AS a, [{bs}] AS bs FROM {tag}_steps_s WHERE i < n AND size > 1))",
        )
        add("swap", f"SELECT k, v, array_to_string(arg_max(ws, i), ' ') AS out FROM {tag}_steps_s GROUP BY k, v")
    if only in (None, "delete"):
        add("kept", f"SELECT *, list_filter(ws, lambda x, j: {u(*seeded('delete', 'j - 1'))} > 0.1::DOUBLE) AS kept FROM {base}")
        add("delete", f"SELECT k, v, array_to_string(CASE WHEN size < 2 THEN ws WHEN len(kept) > 0 THEN kept ELSE [ws[{idx('size', *seeded('delete', q('only')))} + 1]] END, ' ') AS out FROM {tag}_kept")
    return " ".join(names)


def mixed_parts(tag: str, variants: int, num_aug: int, raw: str) -> str:
    """All edits of ``tag`` in hash order, cut, the raw text last: (k, aug, out)."""
    union = " UNION ALL ".join(
        f"SELECT k, v, out, {i * variants} + v AS c FROM {tag}_{e}" for i, e in enumerate(("replace", "insert", "swap", "delete"))
    )
    part(f"{tag}_ranked", f"SELECT k, out, row_number() OVER (PARTITION BY k ORDER BY {h(S, 'k', q('mix'), 'c')}, out) - 1 AS aug FROM ({union})")
    count = min(num_aug, 4 * variants)
    part(f"{tag}_mixed", f"SELECT k, aug, out FROM {tag}_ranked WHERE aug < {count} UNION ALL SELECT k, {count}, text FROM {raw}")
    return f"{tag}_ranked {tag}_mixed"


part("line_ws", f"SELECT id AS k, text, {word_list('text')} AS ws FROM lines")
SYN = "doc_lines lines line_words blocks synonyms line_ws"
PAIRS = "doc_lines line_pairs"
LABELLED = f"{PAIRS} drawn labelled"
SCORED = f"{PAIRS} cleaned cleaned_sets gram_sets scored"

# ---- queries -------------------------------------------------------------------

SQL: dict[str, str] = {}

_fin = f"SELECT *, {finish('prediction')} AS p FROM scored"
SQL["pair_quality"] = with_parts(SCORED, f"SELECT lang, {metric_columns('p', 'label')} FROM ({_fin}) GROUP BY lang")

SQL["read_pairs"] = with_parts(LABELLED, "SELECT * FROM labelled")
SQL["read_unlabelled"] = with_parts("turn_pairs", "SELECT * FROM turn_pairs")
SQL["write_indexed"] = with_parts(LABELLED, 'SELECT row_number() OVER (ORDER BY id) - 1 AS "index", * FROM labelled')
SQL["synonym_table"] = with_parts("doc_lines lines line_words blocks synonyms", "SELECT word, synonyms FROM synonyms")
SQL["metric_log"] = with_parts("history", "SELECT run_id::VARCHAR AS run_id, epoch // 10 AS epoch, round(avg(value), 6) AS train_loss, count(*) AS steps FROM history GROUP BY ALL")

_sep = "{0} || '[SEP]' || {1}"
SQL["model_input"] = with_parts(
    f"{LABELLED} turn_pairs",
    f"SELECT id, {clean('sentence_1')} || '[SEP]' || {clean('sentence_2')} AS text, label AS target FROM labelled "
    f"UNION ALL SELECT id, {clean('sentence_1')} || '[SEP]' || {clean('sentence_2')}, NULL::DOUBLE FROM turn_pairs",
)
SQL["swap_augment"] = with_parts(f"{LABELLED} swapped", "SELECT * FROM swapped")
SQL["label_partition"] = with_parts(
    LABELLED,
    f"SELECT id, l AS label, CASE WHEN l = 0 THEN 'zero' ELSE 'other' END AS part FROM (SELECT id, CASE WHEN {u(S, q('null'), 'id')} >= 0.05 THEN label END AS l FROM labelled)",
)

PLACED = f"{PAIRS} placed"
SQL["row_position"] = with_parts(PLACED, "SELECT id, pos FROM placed")
SQL["split_fractions"] = with_parts(f"{PLACED} place_split", "SELECT id, split FROM place_split")
_file_order = f"SELECT id, row_number() OVER (ORDER BY dev, id DESC) - 1 AS pos, count(*) OVER () AS total FROM (SELECT id, {u(S, q('dev'), 'id')} < 0.06 AS dev FROM labelled)"
SQL["split_file_order"] = with_parts(
    LABELLED,
    f"SELECT id, pos, CASE WHEN pos < trunc(total * 0.7::DOUBLE) THEN 'train' WHEN pos < trunc(total * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ({_file_order})",
)
SQL["assign_batches"] = with_parts(PLACED, "SELECT id, pos, pos // 16 AS batch_id FROM placed WHERE pos < total - total % 16")

SQL["union_pairs"] = with_parts(
    f"{LABELLED} turn_pairs",
    'SELECT * FROM labelled UNION ALL SELECT id, source, sentence_1, sentence_2, NULL::DOUBLE, NULL::DOUBLE FROM turn_pairs',
)
_both = "(SELECT sentence_1, sentence_2 FROM line_pairs UNION ALL SELECT sentence_2, sentence_1 FROM line_pairs)"
SQL["dedup_rows"] = with_parts(PAIRS, f"SELECT DISTINCT * FROM {_both}")
SQL["rows_occurring_once"] = with_parts(PAIRS, f"SELECT sentence_1, sentence_2 FROM {_both} GROUP BY ALL HAVING count(*) = 1")
SQL["sample_complement"] = with_parts(
    f"{LABELLED} swapped all_zeros all_marked all_removed",
    'SELECT id, source, sentence_1, sentence_2, label, "binary-label" FROM all_removed',
)
SQL["sample_exact"] = with_parts(
    PAIRS,
    f"SELECT id, source FROM (SELECT *, row_number() OVER (ORDER BY {h(S, q('sample'), 'id')}, id) - 1 AS r, count(*) OVER () AS n FROM line_pairs) WHERE r < round_even(n * 0.5::DOUBLE, 0)",
)
_order = lambda e: f"row_number() OVER (ORDER BY {h(S, str(e), q('shuffle'), 'id')}, id) - 1"
SQL["shuffle_rows"] = with_parts(PAIRS, f"SELECT id, sentence_1, {_order(0)} AS pos FROM line_pairs")
SQL["epoch_batches"] = with_parts(
    PAIRS,
    " UNION ALL ".join(
        f"SELECT id, pos, pos // 16 AS batch_id, {e} AS epoch FROM (SELECT id, {_order(e)} AS pos, count(*) OVER () AS n FROM line_pairs) WHERE pos < n - n % 16"
        for e in (1, 2)
    ),
)
# Places of an epoch: rounds as columns that follow one another, moved until below n.
def _moved() -> str:
    cells = ["x // b AS row_0", "x % b AS col_0"]
    for i in range(4):
        draw = lambda size, side, other: idx(size, S, "epoch", q("place"), str(i), q(side), other)  # noqa: B023, E731
        cells.append(f"(row_{i} + {draw('a', 'row', f'col_{i}')}) % a AS row_{i + 1}")
        cells.append(f"(col_{i} + {draw('b', 'column', f'row_{i + 1}')}) % b AS col_{i + 1}")
    return f"{', '.join(cells)}, row_4 * b + col_4 AS moved"


def walk_parts(prefix: str, placed: str) -> str:
    """Places ``x`` of both epochs for the positions of ``placed(pos, total)``."""
    part(f"{prefix}_sized", f"SELECT pos, total AS n, ceil(sqrt(total))::BIGINT AS a, ceil(total / ceil(sqrt(total)))::BIGINT AS b FROM {placed}")
    part(
        f"{prefix}_walk",
        f"SELECT pos, epoch, n, a, b, pos AS x, 0 AS step FROM {prefix}_sized CROSS JOIN (SELECT unnest([1, 2]) AS epoch) UNION ALL "
        f"SELECT pos, epoch, n, a, b, moved, step + 1 FROM (SELECT *, {_moved()} FROM {prefix}_walk WHERE step = 0 OR x >= n)",
    )
    part(f"{prefix}_places", f"SELECT pos, x AS place, x // 16 AS batch_id, epoch FROM {prefix}_walk WHERE step > 0 AND x < n - n % 16")
    return f"{prefix}_sized {prefix}_walk {prefix}_places"


_walk = walk_parts("line", "placed")
SQL["epoch_places"] = with_parts(
    f"{PLACED} {_walk}", "SELECT id, place, batch_id, epoch FROM line_places JOIN placed USING (pos)", recursive=True
)
SQL["seeded_draws"] = with_parts(
    "doc_lines lines",
    f"SELECT id, {h(S, 'id', q('h'))} AS h, {u(S, 'id', q('u'))} AS u, {idx('10', S, 'id', q('i'))} AS i FROM lines",
)

SQL["clean_text"] = with_parts(f"{PAIRS} cleaned", "SELECT id, a AS sentence_1, b AS sentence_2 FROM cleaned")
SQL["pair_text"] = with_parts(f"{PAIRS} cleaned", "SELECT id, a || '[SEP]' || b AS text FROM cleaned")
SQL["words"] = with_parts("doc_lines lines line_ws", "SELECT k AS id, ws, array_to_string(ws, ' ') AS joined FROM line_ws")
SQL["keep_script"] = with_parts(
    "doc_lines lines",
    "SELECT id, regexp_replace(text, '[^ㄱ-ㅎㅏ-ㅣ가-힣 ]', '', 'g') AS hangul, regexp_replace(text, '[^a-z ]', '', 'g') AS latin FROM lines",
)
part("pair_words", f"SELECT id, {word_list('sentence_1')} AS w1, {word_list('sentence_2')} AS w2 FROM line_pairs")
part("vocab", "SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 3)::INT AS word_id FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w1 || w2) AS word FROM pair_words) GROUP BY word)")
SQL["build_vocab"] = with_parts(f"{PAIRS} pair_words vocab", "SELECT * FROM vocab")
part("body", "SELECT id, (list_transform(w1, lambda w: 'w' || w) || ['[SEP]'] || list_transform(w2, lambda w: 'w' || w))[1:318] AS items FROM pair_words")
part("body_ids", "SELECT id, list(CASE WHEN item = '[SEP]' THEN 3 ELSE coalesce(word_id, 1) END ORDER BY p) AS ids FROM (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) AS p FROM body) LEFT JOIN vocab ON item = 'w' || word GROUP BY id")
SQL["encode_pad"] = with_parts(
    f"{PAIRS} pair_words vocab body body_ids",
    "SELECT id, [2] || ids || [3] || list_transform(range(318 - len(ids)), lambda x: 0) AS input_ids FROM body_ids",
)

# Sub-words: one part per merge, on words whose symbols stand between control characters.
MERGES = 30
part("subword_0", r"SELECT word, n, regexp_replace(word, '([^ ])', chr(2) || '\1' || chr(3), 'g') AS m FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w1 || w2) AS word FROM pair_words) GROUP BY word)")
_symbols = "string_split(m[2:length(m) - 1], chr(3) || chr(2))"
for _i in range(MERGES):
    part(
        f"merge_{_i}",
        f"SELECT s[j] AS l, s[j + 1] AS r, sum(n)::BIGINT AS c FROM (SELECT n, s, unnest(range(1, len(s))) AS j FROM (SELECT n, {_symbols} AS s FROM subword_{_i})) GROUP BY l, r ORDER BY c DESC, l, r LIMIT 1",
    )
    part(
        f"subword_{_i + 1}",
        f"SELECT word, n, replace(m, chr(2) || l || chr(3) || chr(2) || r || chr(3), chr(2) || l || r || chr(3)) AS m FROM subword_{_i} CROSS JOIN merge_{_i}",
    )
SUBWORDS = "subword_0 " + " ".join(f"merge_{i} subword_{i + 1}" for i in range(MERGES))
SQL["learn_subwords"] = with_parts(
    f"{PAIRS} pair_words {SUBWORDS}",
    " UNION ALL ".join(f'SELECT {i}::BIGINT AS step, l AS "left", r AS "right", c AS n FROM merge_{i}' for i in range(MERGES)),
)
part(
    "cut_words",
    f"SELECT id, k, list(x ORDER BY p, j) AS w FROM (SELECT id, k, p, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM (SELECT id, k, p, {_symbols} AS s FROM (SELECT id, 1 AS k, unnest(w1) AS word, generate_subscripts(w1, 1) AS p FROM pair_words UNION ALL SELECT id, 2, unnest(w2), generate_subscripts(w2, 1) FROM pair_words) JOIN subword_{MERGES} USING (word))) GROUP BY id, k",
)
part("cut_pairs", "SELECT p.id, coalesce(a.w, []) AS w1, coalesce(b.w, []) AS w2 FROM pair_words p LEFT JOIN cut_words a ON a.id = p.id AND a.k = 1 LEFT JOIN cut_words b ON b.id = p.id AND b.k = 2")
for _new, _old in (("cut_vocab", "vocab"), ("cut_body", "body"), ("cut_ids", "body_ids")):
    part(_new, re.sub(r"\bbody\b", "cut_body", re.sub(r"\bvocab\b", "cut_vocab", PARTS[_old].replace("pair_words", "cut_pairs"))))
SQL["encode_subwords"] = with_parts(
    f"{PAIRS} pair_words {SUBWORDS} cut_words cut_pairs cut_vocab cut_body cut_ids",
    "SELECT id, [2] || ids || [3] || list_transform(range(318 - len(ids)), lambda x: 0) AS input_ids FROM cut_ids",
)

SQL["balance_labels"] = with_parts(f"{LABELLED} swapped {balance_names('all')}", "SELECT * FROM all_balanced")
SQL["synonym_lookup"] = with_parts(
    SYN,
    "SELECT k AS id, count(*) AS n_words, count(synonyms) AS n_known, sum(coalesce(len(synonyms), 0))::BIGINT AS n_synonyms, max(synonyms[1]) AS last_first FROM (SELECT k, unnest(ws) AS w FROM line_ws) LEFT JOIN synonyms ON w = word GROUP BY k",
)
for _e in ("replace", "insert", "swap", "delete"):
    _names = edit_parts("line_ws", f"one_{_e}", 2, _e)
    _syn = SYN if _e in ("replace", "insert") else "doc_lines lines line_ws"
    SQL[f"eda_{_e}"] = with_parts(
        f"{_syn} {_names}", f"SELECT k AS id, v::INT AS edit_variant, out AS augmented FROM one_{_e}_{_e}", True
    )
_names = edit_parts("line_ws", "nine", 3)
_mix = mixed_parts("nine", 3, 9, "line_ws")
SQL["eda_sentence"] = with_parts(f"{SYN} {_names} {_mix}", "SELECT k AS id, aug::INT AS aug, out AS augmented FROM nine_mixed", True)

_pairs_syn = "doc_lines lines line_words blocks synonyms line_pairs drawn labelled"


def pair_edit_parts(source: str, key: str, tag: str) -> str:
    """Edits of both sentences of ``source`` and the zipped rows ``{tag}_rows``."""
    part(
        f"{tag}_ws",
        f"SELECT concat_ws('|', {key}, 'sentence_1') AS k, sentence_1 AS text, {word_list('sentence_1')} AS ws FROM {source} "
        f"UNION ALL SELECT concat_ws('|', {key}, 'sentence_2'), sentence_2, {word_list('sentence_2')} FROM {source}",
    )
    names = edit_parts(f"{tag}_ws", tag, 1)
    mix = mixed_parts(tag, 1, 3, f"{tag}_ws")
    part(
        f"{tag}_rows",
        f"SELECT p.*, a.aug::INT AS aug, a.out AS x, b.out AS y FROM {source} p JOIN {tag}_mixed a ON a.k = concat_ws('|', {key}, 'sentence_1') "
        f"JOIN {tag}_mixed b ON b.k = concat_ws('|', {key}, 'sentence_2') AND b.aug = a.aug "
        f"UNION ALL SELECT *, -1, sentence_1, sentence_2 FROM {source}",
    )
    return f"{tag}_ws {names} {mix} {tag}_rows"


_p = pair_edit_parts("labelled", "id", "pe")
SQL["eda_pairs"] = with_parts(
    f"{_pairs_syn} {_p}",
    'SELECT id, source, label, "binary-label", aug, x AS sentence_1, y AS sentence_2 FROM pe_rows',
    True,
)

BACK = "doc_lines lines line_pairs back_texts backed"
SQL["back_translate"] = with_parts(BACK, "SELECT id, coalesce(back_1, sentence_1) AS sentence_1, coalesce(back_2, sentence_2) AS sentence_2 FROM backed")
SQL["back_translate_misses"] = with_parts(
    BACK,
    "SELECT count(*) FILTER (WHERE back_1 IS NULL) AS first_misses, count(*) FILTER (WHERE back_1 IS NULL) + count(*) FILTER (WHERE back_2 IS NULL) AS total_misses, count(*) AS pairs FROM backed",
)
part("forms", "SELECT id, source, sentence_1 AS s1, sentence_2 AS s2, coalesce(back_1, sentence_1) AS b1, coalesce(back_2, sentence_2) AS b2 FROM backed")
part("four", "SELECT id, source, s1 AS x, s2 AS y FROM forms UNION ALL SELECT id, source, b1, s2 FROM forms UNION ALL SELECT id, source, s1, b2 FROM forms UNION ALL SELECT id, source, b1, b2 FROM forms")
SQL["back_translation"] = with_parts(
    f"{BACK} forms four",
    "SELECT DISTINCT id, source, x AS sentence_1, y AS sentence_2 FROM (SELECT * FROM four UNION ALL SELECT id, source, y, x FROM four)",
)

SQL["label_distribution"] = with_parts(
    f"{LABELLED} id_split",
    "SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM (SELECT split, label, count(*) AS n FROM id_split GROUP BY ALL)",
)
SQL["pearson"] = with_parts(SCORED, f"SELECT source, lang, round({pearson('prediction', 'label')}, 6) AS pearson FROM scored GROUP BY ALL")
SQL["batch_pearson"] = with_parts(
    SCORED,
    f"SELECT count(*) AS batches, count(*) FILTER (WHERE isnan(r)) AS undefined_batches, round(sum(n * r) / sum(n), 6) AS mean_pearson, "
    f"round(sum(n * r) FILTER (WHERE NOT isnan(r)) / sum(n) FILTER (WHERE NOT isnan(r)), 6) AS mean_defined_pearson FROM ("
    f"SELECT pos // 16 AS b, count(*) AS n, {pearson('prediction', 'label')} AS r FROM (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos FROM scored) GROUP BY b)",
)
_r = pearson("prediction", "label")
SQL["losses"] = with_parts(
    SCORED,
    f"SELECT source, round(avg(abs(prediction - label)), 6) AS \"L1\", round(avg(pow(prediction - label, 2)), 6) AS \"MSE\", "
    f"round({huber('prediction', 'label')}, 6) AS \"Huber\", round(1 - pow({_r}, 2), 6) AS plcc, round(1 - ({_r}), 6) AS plcc_plain FROM scored GROUP BY source",
)

SQL["early_stop"] = with_parts(
    "history",
    "SELECT run_id, min(epoch) FILTER (WHERE epoch - last_up >= 5) AS stop_epoch, count(*) AS epochs FROM ("
    "SELECT *, max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS last_up FROM ("
    "SELECT *, coalesce(value > max(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM history)) GROUP BY run_id",
)
SQL["stream_early_stop"] = SQL["early_stop"]
SQL["top_checkpoints"] = with_parts(
    "history",
    "SELECT run_id, epoch, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, epoch) AS rank FROM history) WHERE rank <= 4",
)
SQL["best_trial"] = with_parts(
    "history",
    "SELECT * FROM (SELECT run_id, value, 'minimize' AS goal FROM history ORDER BY value, run_id LIMIT 1) UNION ALL SELECT * FROM (SELECT run_id, value, 'maximize' AS goal FROM history ORDER BY value DESC, run_id LIMIT 1)",
)

THREE = f"{PAIRS} cleaned cleaned_sets gram_sets three"
SQL["postprocess"] = with_parts(THREE, f"SELECT model, id, {finish('(prediction * 1.5::DOUBLE - 1.0::DOUBLE)')} AS target FROM three")
SQL["submission"] = with_parts(
    SCORED, f"SELECT id, CASE WHEN {u(S, q('scored'), 'id')} >= 0.1 THEN {finish('prediction')} END AS target FROM scored"
)
SQL["ensemble_weighted"] = with_parts(
    THREE,
    "SELECT id, round(sum(w * prediction) / sum(w), 6) AS prediction FROM (SELECT *, CASE model WHEN 'char2' THEN 0.2::DOUBLE WHEN 'char3' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS w FROM three) GROUP BY id",
)

SQL["pair_features"] = with_parts(
    f"{PAIRS} cleaned cleaned_sets gram_sets",
    f"SELECT id, round({jaccard('wa', 'wb')}, 6) AS word_jaccard, "
    f"round(CASE WHEN least(len(wa), len(wb)) > 0 THEN len(list_intersect(wa, wb))::DOUBLE / least(len(wa), len(wb)) ELSE 0.0 END, 6) AS word_overlap, "
    f"round({jaccard('a2', 'b2')}, 6) AS char2_jaccard, round({jaccard('a3', 'b3')}, 6) AS char3_jaccard, round({ratio('a', 'b')}, 6) AS length_ratio FROM gram_sets",
)
part("tokens", f"SELECT id, unnest({word_list('a')}) AS word, 1 AS x, 0 AS y FROM cleaned UNION ALL SELECT id, unnest({word_list('b')}), 0, 1 FROM cleaned")
part("tf", "SELECT id, word, sum(x) AS x, sum(y) AS y FROM tokens GROUP BY ALL")
part("dfs", "SELECT word, count(*) FILTER (WHERE x > 0) + count(*) FILTER (WHERE y > 0) AS df FROM tf GROUP BY word")
part("weights", "SELECT id, x * idf AS x, y * idf AS y FROM (SELECT tf.*, ln(((SELECT 2 * count(*) FROM cleaned) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) AS idf FROM tf JOIN dfs USING (word))")
SQL["tfidf_cosine"] = with_parts(
    f"{PAIRS} cleaned tokens tf dfs weights",
    "SELECT id, round(coalesce(c, 0), 6) AS tfidf_cosine FROM (SELECT id FROM cleaned) LEFT JOIN (SELECT id, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS c FROM weights GROUP BY id) USING (id)",
)
SQL["embedding_cosine"] = (
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)

# Least squares on two features in closed form from the moments of the train split.
part("feats", f"SELECT s.id, s.label, s.prediction / 5 AS f, {ratio('a', 'b')} AS g, split FROM scored s JOIN cleaned USING (id) JOIN place_split USING (id)")
part("moments", "SELECT var_pop(f) AS ff, var_pop(g) AS gg, covar_pop(f, g) AS fg, covar_pop(f, label) AS fy, covar_pop(g, label) AS gy, avg(f) AS mf, avg(g) AS mg, avg(label) AS my FROM feats WHERE split = 'train'")
part("ols", "SELECT (fy * gg - gy * fg) / (ff * gg - fg * fg) AS wf, (gy * ff - fy * fg) / (ff * gg - fg * fg) AS wg, mf, mg, my FROM moments")
part("fitted", "SELECT id, split, label, my + wf * (f - mf) + wg * (g - mg) AS prediction FROM feats CROSS JOIN ols")
FIT = f"{SCORED} placed place_split feats moments ols fitted"
SQL["score_pairs"] = with_parts(FIT, "SELECT id, round(prediction, 6) AS prediction FROM fitted")
SQL["evaluate"] = with_parts(FIT, f"SELECT split, {metric_columns('prediction', 'label')} FROM fitted GROUP BY split")
SQL["attach_by_position"] = with_parts(SCORED, f"SELECT id, {finish('prediction')} AS target FROM scored")
SQL["missing_predictions"] = with_parts(
    SCORED, f"SELECT count(*) AS template_rows, count(*) FILTER ({u(S, q('scored'), 'id')} < 0.1) AS missing FROM scored"
)

# Reweighted least squares on two features: one part per round, solved in closed form.
ROBUST_WEIGHTS = {
    "L1": "1 / greatest(abs(r), 0.001::DOUBLE)",
    "Huber": "CASE WHEN abs(r) <= 1 THEN 1.0::DOUBLE ELSE 1 / abs(r) END",
}
ROBUST_LOSSES = {"L1": "avg(abs(r))", "Huber": "avg(CASE WHEN abs(r) <= 1 THEN 0.5 * r * r ELSE abs(r) - 0.5 END)"}
FIT_ROUNDS, FIT_DECAY = 8, 0.001


def solved(weight: str, source: str, penalty: str, value: str = "NULL") -> str:
    """Weighted least squares of the label on f and g, as (wf, wg, c, loss)."""
    return (
        f"SELECT wf, wg, my - wf * mf - wg * mg AS c, loss FROM (SELECT *, "
        f"(fy * (gg + {penalty}) - gy * fg) / ((ff + {penalty}) * (gg + {penalty}) - fg * fg) AS wf, "
        f"(gy * (ff + {penalty}) - fy * fg) / ((ff + {penalty}) * (gg + {penalty}) - fg * fg) AS wg FROM ("
        f"SELECT loss, sf / s AS mf, sg / s AS mg, sy / s AS my, (sff - sf * sf / s) / n AS ff, (sgg - sg * sg / s) / n AS gg, "
        f"(sfg - sf * sg / s) / n AS fg, (sfy - sf * sy / s) / n AS fy, (sgy - sg * sy / s) / n AS gy FROM ("
        f"SELECT count(*) AS n, {value} AS loss, sum(w) AS s, sum(w * f) AS sf, sum(w * g) AS sg, sum(w * label) AS sy, "
        f"sum(w * f * f) AS sff, sum(w * g * g) AS sgg, sum(w * f * g) AS sfg, sum(w * f * label) AS sfy, sum(w * g * label) AS sgy "
        f"FROM (SELECT *, {weight} AS w FROM ({source})))))"
    )


_train_rows = "SELECT f, g, label FROM feats WHERE split = 'train'"
for _name, _weight in ROBUST_WEIGHTS.items():
    part(f"{_name.lower()}_0", solved("1.0::DOUBLE", _train_rows, str(FIT_DECAY)))
    for _i in range(FIT_ROUNDS):
        _rows = f"SELECT f, g, label, label - (c + wf * f + wg * g) AS r FROM feats CROSS JOIN {_name.lower()}_{_i} WHERE split = 'train'"
        part(f"{_name.lower()}_{_i + 1}", solved(_weight, _rows, str(2 * FIT_DECAY), ROBUST_LOSSES[_name]))
ROUNDS = {n: " ".join(f"{n.lower()}_{i}" for i in range(FIT_ROUNDS + 1)) for n in ROBUST_WEIGHTS}
_robust = {n: f"SELECT label, c + wf * f + wg * g AS prediction FROM feats CROSS JOIN {n.lower()}_{FIT_ROUNDS} WHERE split = 'validation'" for n in ROBUST_WEIGHTS}
_least = "SELECT label, prediction FROM fitted WHERE split = 'validation'"
_fits = {"L1": _robust["L1"], "MSE": _least, "Huber": _robust["Huber"], "plcc": _least}
SQL["fit_similarity"] = with_parts(
    f"{FIT} {ROUNDS['L1']} {ROUNDS['Huber']}",
    " UNION ALL ".join(
        f"SELECT 'validation' AS split, {metric_columns('prediction', 'label', 4)}, '{n}' AS fit FROM ({rows})" for n, rows in _fits.items()
    ),
)
SQL["fit_log"] = with_parts(
    f"{FIT} {ROUNDS['L1']} {ROUNDS['Huber']}",
    " UNION ALL ".join(
        f"SELECT '{n}' AS run_id, {i}::BIGINT AS epoch, 'train_loss' AS metric, round(loss, 5) AS value FROM {n.lower()}_{i + 1}"
        for n in ROBUST_WEIGHTS
        for i in range(FIT_ROUNDS)
    ),
)
_names = ["1", "f", "g", "label"]
SQL["split_moments"] = with_parts(
    f"{SCORED} placed place_split feats",
    "SELECT split, count(*) AS n, "
    + ", ".join(f"round(sum({_names[i]}::DOUBLE * {_names[j]}), 4) AS s{i}_{j}" for i in range(4) for j in range(i, 4))
    + " FROM feats GROUP BY split",
)
DECAYS = (0.0, 0.001, 0.01, 0.1, 1.0)
part("trials", f"SELECT id, [{', '.join(f'{d}::DOUBLE' for d in DECAYS)}][{idx(str(len(DECAYS)), S, q('trial'), 'id')} + 1] AS d FROM range(6) t(id)")
part("ridges", "SELECT id, (fy * (gg + d) - gy * fg) / ((ff + d) * (gg + d) - fg * fg) AS wf, (gy * (ff + d) - fy * fg) / ((ff + d) * (gg + d) - fg * fg) AS wg, mf, mg, my FROM moments CROSS JOIN trials")
part("trial_rows", "SELECT r.id, label, my + wf * (f - mf) + wg * (g - mg) AS p FROM feats CROSS JOIN ridges r WHERE split = 'validation'")
part("trial_log", f"SELECT format('trial-{{:03d}}', id) AS run_id, avg((label - p) * (label - p)) AS loss, {pearson('p', 'label')} AS r FROM trial_rows GROUP BY id")
SQL["tune_similarity"] = with_parts(
    f"{SCORED} placed place_split feats moments trials ridges trial_rows trial_log",
    "SELECT run_id, 0::BIGINT AS epoch, 'val_loss' AS metric, round(loss, 5) AS value FROM trial_log UNION ALL "
    "SELECT run_id, 0, 'val_pearson', round(r, 5) FROM trial_log UNION ALL "
    "SELECT * FROM (SELECT run_id, 0, 'best_val_loss', round(loss, 5) FROM trial_log ORDER BY loss, run_id LIMIT 1)",
)
part("blend", "SELECT least(1.0, greatest(0.0, sum((f - g) * (label / 5 - g)) / sum((f - g) * (f - g)))) AS w FROM feats WHERE split = 'train'")
SQL["ensemble_fitted"] = with_parts(
    f"{SCORED} placed place_split feats blend",
    "SELECT id, round(5 * (w * f + (1 - w) * g), 5) AS prediction FROM feats CROSS JOIN blend",
)
SQL["score_with_function"] = with_parts(PAIRS, f"SELECT id, round(5 * {ratio('sentence_1', 'sentence_2')}, 6) AS prediction FROM line_pairs")

SQL["training_table"] = with_parts(
    f"{LABELLED} id_split clean_split train_swapped {balance_names('train')}",
    "SELECT *, 'train' AS split FROM train_balanced UNION ALL SELECT id, source, sentence_1, sentence_2, label, \"binary-label\", 'orig', 'other', split FROM clean_split WHERE split <> 'train'",
)
part("flow_words", f"SELECT id, variant, role, label, {word_list('sentence_1')} AS w1, {word_list('sentence_2')} AS w2 FROM train_balanced")
part("flow_vocab", "SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 3)::INT AS word_id FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w1 || w2) AS word FROM flow_words) GROUP BY word)")
part("flow_placed", "SELECT *, row_number() OVER (ORDER BY id, variant, role) - 1 AS pos, count(*) OVER () AS total FROM flow_words")
part("flow_items", "SELECT pos, (list_transform(w1, lambda w: 'w' || w) || ['[SEP]'] || list_transform(w2, lambda w: 'w' || w))[1:318] AS items FROM flow_placed")
part("flow_ids", "SELECT pos, list(CASE WHEN item = '[SEP]' THEN 3 ELSE coalesce(word_id, 1) END ORDER BY p) AS ids FROM (SELECT pos, unnest(items) AS item, generate_subscripts(items, 1) AS p FROM flow_items) LEFT JOIN flow_vocab ON item = 'w' || word GROUP BY pos")
_walk = walk_parts("flow", "flow_placed")
SQL["encoded_epochs"] = with_parts(
    f"{LABELLED} id_split clean_split train_swapped {balance_names('train')} flow_words flow_vocab flow_placed flow_items flow_ids {_walk}",
    "SELECT id, variant, role, label, [2] || ids || [3] || list_transform(range(318 - len(ids)), lambda x: 0) AS input_ids, place, batch_id, epoch "
    "FROM flow_places JOIN flow_placed USING (pos) JOIN flow_ids USING (pos)",
    recursive=True,
)


def _translated(c: str) -> str:
    turned = f"array_to_string(list_reverse(string_split({c}, ' ')), ' ')"
    return f"CASE WHEN {u(S, q('back'), c)} >= 0.1::DOUBLE THEN {turned} ELSE {c} END"


part("turned", f"SELECT *, {_translated('sentence_1')} AS back_1, {_translated('sentence_2')} AS back_2 FROM id_split WHERE split = 'train'")
_label = 'id, source, label, "binary-label"'
part("turned_forms", " UNION ALL ".join(f"SELECT {_label}, {x} AS x, {y} AS y FROM turned" for x in ("sentence_1", "back_1") for y in ("sentence_2", "back_2")))
part("turned_pairs", f"SELECT DISTINCT * FROM (SELECT * FROM turned_forms UNION ALL SELECT {_label}, y, x FROM turned_forms)")
SQL["back_translated_table"] = with_parts(
    f"{LABELLED} id_split turned turned_forms turned_pairs",
    f'SELECT {_label}, x AS sentence_1, y AS sentence_2, row_number() OVER (ORDER BY id, x, y) - 1 AS "index", \'train\' AS split FROM turned_pairs '
    f'UNION ALL SELECT {_label}, sentence_1, sentence_2, row_number() OVER (PARTITION BY split ORDER BY id) - 1, split FROM id_split WHERE split <> \'train\'',
)
part("raw_swapped", "SELECT id, source, sentence_1, sentence_2, label, \"binary-label\", 'orig' AS variant FROM id_split WHERE split = 'train' UNION ALL SELECT id, source, sentence_2, sentence_1, label, \"binary-label\", 'swap' FROM id_split WHERE split = 'train'")
_t = pair_edit_parts("raw_swapped", "id, variant", "te")
SQL["augmented_training_table"] = with_parts(
    f"{_pairs_syn} id_split raw_swapped {_t}",
    f'SELECT id, variant, source, label, "binary-label", aug, x AS sentence_1, y AS sentence_2, '
    f"row_number() OVER (ORDER BY {h(S, '0', q('shuffle'), 'id', 'variant', 'aug')}, id, variant, aug) - 1 AS pos, 'train' AS split FROM te_rows "
    "UNION ALL BY NAME SELECT id, 'orig' AS variant, source, label, \"binary-label\", sentence_1, sentence_2, split FROM id_split WHERE split <> 'train'",
    True,
)
_score = finish(f"5 * {ratio('a', 'b')}")
SQL["prediction_run"] = with_parts(
    "turn_pairs", f"SELECT id, {_score} AS target FROM (SELECT id, {clean('sentence_1')} AS a, {clean('sentence_2')} AS b FROM turn_pairs)"
)
SQL["stream_targets"] = SQL["prediction_run"]
