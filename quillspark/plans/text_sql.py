"""SQL of the queries in ``text.py``: dictionaries become tables of constants."""

from __future__ import annotations

import re

from ..functions import vocab
from ..functions.issues import CATEGORIES, ISSUES, NO_CATEGORY
from ..functions.taxonomy import SUBJECT_HINTS, TAXONOMY, WEIGHTS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::VARCHAR[]"


def rows(name: str, columns: str, values) -> str:
    """A table of constants: each row a tuple of strings, numbers and lists of strings."""
    cell = lambda v: quoted(v) if isinstance(v, str) else texts(v) if isinstance(v, (list, tuple)) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in values)})"


def planted(lines, table: str = "documents", key: str = "doc_id") -> str:
    return f"kd AS (SELECT {key}, list_extract({texts(lines)}, ({key} % {len(lines)} + 1)::BIGINT) || chr(10) || text AS text FROM {table})"


ISSUE_ROWS = rows("issue", "pos, k, c, rel, w", [(n, k, c, r, w) for n, (k, c, r, w) in enumerate(ISSUES)])
PRIORITY = rows("priority", "c, p", [(c, n) for n, c in enumerate(CATEGORIES)])


def issue_graph(lines) -> str:
    return f"""WITH {planted(lines)}, {ISSUE_ROWS}, {PRIORITY},
        hit AS (SELECT doc_id, pos, k, c, rel, w FROM kd JOIN issue ON contains(text, k)),
        direct AS (SELECT doc_id, string_agg(k, ',' ORDER BY pos) AS direct, list(k) AS ks FROM hit GROUP BY doc_id),
        step AS (SELECT doc_id, pos * 100 + unnest(range(len(rel))) AS pos_, unnest(rel) AS r FROM hit),
        one AS (SELECT s.doc_id, r, min(pos_) AS pos_ FROM step s JOIN direct USING (doc_id) WHERE NOT list_contains(ks, r) GROUP BY s.doc_id, r),
        related AS (SELECT doc_id, string_agg(r, ',' ORDER BY pos_) AS related FROM one GROUP BY doc_id),
        total AS (SELECT doc_id, c, sum(w) AS n FROM hit GROUP BY doc_id, c),
        best AS (SELECT doc_id, arg_min(c, -n * 10 + p) AS category FROM total JOIN priority USING (c) GROUP BY doc_id)
        SELECT doc_id, coalesce(direct, '') AS direct, coalesce(related, '') AS related, coalesce(category, '{NO_CATEGORY}') AS category
        FROM kd LEFT JOIN direct USING (doc_id) LEFT JOIN related USING (doc_id) LEFT JOIN best USING (doc_id)"""


def taxonomy_paths(lines) -> str:
    hints = [(n, s, h) for n, (s, hs) in enumerate(SUBJECT_HINTS.items()) for h in hs]
    tree = [(s, n, c, m, leaf) for s, cs in TAXONOMY.items() for n, (c, ls) in enumerate(cs.items()) for m, leaf in enumerate(ls)]
    score = lambda x: f"(2 * contains(t, {x})::INT + contains(t, left({x}, 2))::INT)"
    return f"""WITH {planted(lines)}, {rows("hint", "n, subject, h", hints)}, {rows("tree", "subject, cn, category, ln, leaf", tree)},
        x AS (SELECT doc_id, left(trim(coalesce(text, '')), 220) AS t FROM kd),
        s AS (SELECT doc_id, arg_min(subject, n) AS subject FROM x JOIN hint ON contains(t, h) WHERE length(t) >= 8 GROUP BY doc_id),
        c AS (SELECT doc_id, arg_min(category, cn - 100 * {score("category")}) AS category FROM x JOIN s USING (doc_id) JOIN tree USING (subject) WHERE {score("category")} > 0 GROUP BY doc_id),
        l AS (SELECT doc_id, arg_min(leaf, ln - 100 * {score("leaf")}) AS leaf FROM x JOIN s USING (doc_id) JOIN c USING (doc_id) JOIN tree USING (subject, category) WHERE {score("leaf")} > 0 GROUP BY doc_id)
        SELECT doc_id, CASE WHEN subject IS NULL THEN '' ELSE concat_ws(' > ', subject, category, leaf) END AS path
        FROM x LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""


URLS = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), 'www\.\S+', ' ', 'g'), 'portal\.scourt\.go\.kr\S*', ' ', 'g')"
NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + URLS
    + r", '\[\s*(판시사항|판결요지|참조조문|참조판례|전문|주문|원심판결|이유)\s*\]', E'\n[\\1]\n', 'g'), '[\t\r\f\x0B]', ' ', 'g'), '\n{2,}', E'\n', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
)


def last_end(head: str, endings) -> str:
    """Where the last of the endings stops (0: none)."""
    back = lambda e: f"strpos(reverse({head}), {quoted(e[::-1])})"
    return "greatest(" + ", ".join(f"CASE WHEN {back(e)} > 0 THEN length({head}) - {back(e)} + 1 ELSE 0 END" for e in endings) + ")"


def truncated(lines, limit: int, card, display, mark: str) -> str:
    """Composed documents shortened as cards and as sentences to show."""
    least, space = max(20, limit // 3), "(length(h) - strpos(reverse(h), ' '))"
    at_space = f"regexp_replace(CASE WHEN strpos(h, ' ') > 0 AND {space} >= {least} THEN left(h, {space}) ELSE h END, '^\\s+|\\s+$', '', 'g') || {quoted(mark)}"
    cut = lambda end: f"CASE WHEN {end} >= {least} THEN trim(left(h, {end})) ELSE {at_space} END"
    return f"""WITH {composed(lines)}, q AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM kd),
        p AS (SELECT doc_id, t, left(t, {limit}) AS h FROM q), e AS (SELECT *, {last_end("h", card)} AS c, {last_end("h", display)} AS d FROM p)
        SELECT doc_id, CASE WHEN length(t) <= {limit} THEN t ELSE {cut("c")} END AS card,
          CASE WHEN length(t) <= {limit} THEN CASE WHEN NOT (t LIKE '%.' OR t LIKE '%…') AND (t LIKE '%다' OR t LIKE '%요') THEN t || '.' ELSE t END
               WHEN d < {least} AND length(t) <= {2 * limit} THEN t ELSE {cut("d")} END AS display FROM e"""


def quiz_lines(lines, flips) -> str:
    """Summaries of composed documents and three statements of their first lines."""
    least, gap = 36, "(length(h) - strpos(reverse(h), ' '))"

    def clipped(source: str, columns: str, x: str, to: str) -> str:
        """A table with the column shortened to 110 characters and closed, in three steps."""
        end = last_end("h", vocab.CUT_ENDINGS)
        return f"""{to}0 AS (SELECT {columns}, trim(regexp_replace({x}, '\\s+', ' ', 'g')) AS t FROM {source}), {to}1 AS (SELECT {columns}, t, left(t, 110) AS h FROM {to}0), {to}2 AS (SELECT *, {end} AS stop FROM {to}1),
        {to}3 AS (SELECT {columns}, CASE WHEN length(t) <= 110 THEN t WHEN stop >= {least} THEN trim(left(h, stop)) WHEN {gap} >= {least} AND {gap} < length(h) THEN rtrim(left(h, {gap})) || '…' ELSE rtrim(h) || '…' END AS v FROM {to}2),
        {to} AS (SELECT {columns}, CASE WHEN v = '' OR regexp_matches(v, '({"|".join(map(re.escape, vocab.TERMINALS))})$') THEN v ELSE v || '…' END AS {to} FROM {to}3)"""

    first = lambda p: f"strpos(clip, {quoted(p)})"
    flip = "CASE " + " ".join(f"WHEN {first(p)} > 0 AND NOT contains(clip, {quoted(n)}) THEN left(clip, {first(p)} - 1) || {quoted(n)} || substr(clip, {first(p)} + {len(p)})" for p, n in flips) + " END"
    return f"""WITH {composed(lines)}, l0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 14)[1:3] AS ls FROM kd),
        l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM l0), {clipped("l", "doc_id, i", "l", "clip")},
        n AS (SELECT doc_id, i, clip, {flip} AS n FROM clip WHERE i = 1), {clipped("(SELECT * FROM n WHERE n IS NOT NULL)", "doc_id, i", "n", "no")},
        k0 AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({texts(vocab.STOPWORDS)}, w)) AS ws FROM kd)),
        k1 AS (SELECT doc_id, w, min(p) AS p FROM k0 GROUP BY doc_id, w), k2 AS (SELECT doc_id, list(w ORDER BY p)[1:5] AS ks FROM k1 GROUP BY doc_id), k AS (SELECT doc_id, coalesce(ks, []) AS ks FROM kd LEFT JOIN k2 USING (doc_id)),
        q AS (SELECT clip.doc_id, string_agg(CASE WHEN clip.i % 2 = 0 THEN 'O ' || clip ELSE 'X ' || coalesce(no, '본 판례는 ' || coalesce(ks[1], '핵심 쟁점') || ' 와 무관한 사안에 대한 판단이다.') END, ' | ' ORDER BY clip.i) AS quiz,
          string_agg(clip, ' | ' ORDER BY clip.i) AS citations, max(clip) FILTER (clip.i = 0) AS ruling FROM clip JOIN k USING (doc_id) LEFT JOIN no ON no.doc_id = clip.doc_id AND no.i = clip.i GROUP BY clip.doc_id)
        SELECT k.doc_id AS doc, CASE WHEN len(ks) > 0 THEN 'doc ' || k.doc_id || ' 판례는 ' || array_to_string(ks[1:3], ', ') || ' 등을 핵심 쟁점으로 다룬 판례이다.' ELSE 'doc ' || k.doc_id || ' 판례의 핵심 쟁점은 제공된 문장에서 직접 확인이 필요하다.' END AS one_line_summary,
          coalesce(ks[1], '핵심 쟁점 확인 필요') AS key_issue, coalesce(ruling, '핵심 문장 정보가 부족합니다.') AS ruling_point, '시험 포인트: ' || array_to_string(ks, ', ') AS exam_takeaway,
          coalesce(quiz, CASE WHEN len(ks) > 0 THEN 'O ' || ks[1] || ' 은(는) 본 판례의 핵심 쟁점이다.' END, '') AS quiz, coalesce(citations, '') AS citations
        FROM k LEFT JOIN q USING (doc_id)"""


def labels(lines) -> str:
    return f"""SELECT doc_id, domain, class, confidence, runner_up, direct
        FROM ({study_domains(lines)}) JOIN ({study_classes(lines)}) USING (doc_id) JOIN ({issue_graph(lines)}) USING (doc_id)"""


def cases(overlap: int) -> str:
    """Documents as cases, and all their fields normalised."""
    return f"""case_fields AS (SELECT doc_id, '2024도' || doc_id AS number, source AS name, lang AS subject, substr(text, 1, ceil(length(text) / 3)::INT + {overlap}) AS issue,
          substr(text, ceil(length(text) / 3)::INT + 1, ceil(length(text) / 3)::INT + {overlap}) AS holding, substr(text, 2 * ceil(length(text) / 3)::INT + 1, ceil(length(text) / 3)::INT) AS points FROM documents),
        case_texts AS (SELECT *, concat_ws(' ', nullif(name, ''), nullif(subject, ''), nullif(issue, ''), nullif(holding, ''), nullif(points, '')) AS text FROM case_fields),
        cases AS (SELECT *, {NORMAL} AS whole FROM case_texts)"""


def study_domains(lines) -> str:
    hints = [(n, d, h) for n, (d, hs) in enumerate(vocab.DOMAIN_HINTS.items()) for h in hs]
    return f"""WITH {planted(lines)}, {rows("hint", "n, domain, h", hints)}, x AS (SELECT doc_id, lower({URLS}) AS t FROM kd),
        c AS (SELECT doc_id, domain, n, count(*) AS hits FROM x JOIN hint ON contains(t, h) GROUP BY ALL),
        b AS (SELECT doc_id, arg_min(domain, n - 100 * hits) AS domain, max(hits) AS hits FROM c GROUP BY doc_id)
        SELECT doc_id, CASE WHEN hits >= 2 THEN domain ELSE '{vocab.GENERAL_DOMAIN}' END AS domain FROM x LEFT JOIN b USING (doc_id)"""


def study_classes(lines, source: str | None = None) -> str:
    weights = [(c, h, float(w)) for c in sorted(WEIGHTS) for h, w in WEIGHTS[c].items()]
    return f"""WITH {source or planted(lines)}, {rows("weight", "name, h, w", weights)},
        x AS (SELECT doc_id, replace(regexp_replace(replace(coalesce(text, '') || ' ', '헌법재판소', chr(1)), '헌법상|헌법적', ' ', 'g'), chr(1), '헌법재판소') AS t FROM kd),
        hit AS (SELECT doc_id, name, w FROM x JOIN weight ON contains(t, h) AND (h <> '형법' OR regexp_matches(t, '형법(제|상|총칙|각칙)') OR NOT contains(t, '형사소송법'))),
        total AS (SELECT doc_id, name, coalesce(sum(hit.w), 0.0)::DOUBLE AS n FROM (SELECT doc_id, name FROM x CROSS JOIN (SELECT DISTINCT name FROM weight)) LEFT JOIN hit USING (doc_id, name) GROUP BY ALL),
        ranked AS (SELECT doc_id, list(name ORDER BY n DESC, name) AS names, list(n ORDER BY n DESC, name) AS ns FROM total GROUP BY doc_id),
        r AS (SELECT doc_id, names, ns[1] AS best, ns[1] / (ns[1] + ns[2] + 0.1::DOUBLE) AS sure FROM ranked)
        SELECT doc_id, CASE WHEN best < 2 THEN 'general' ELSE names[1] END AS class, round(CASE WHEN best < 2 THEN 0.0 ELSE sure END, 4)::DOUBLE AS confidence,
          CASE WHEN best >= 2 AND sure < 0.7 THEN names[2] END AS runner_up FROM r"""


def composed(lines) -> str:
    """Documents with three lines in front, each chosen by another modulus."""
    at = lambda k: f"list_extract({texts(lines)}, ({k}) % {len(lines)} + 1)"
    return f"kd AS (SELECT doc_id, {at('doc_id')} || chr(10) || {at('doc_id // 7')} || chr(10) || {at('doc_id // 3 + 5')} || chr(10) || coalesce(text, '') AS text FROM documents)"


def sentences(text: str) -> str:
    """The sentences of a normalised text as a list."""
    for pattern in (r"([다요죠음임])[.。]\s+([가-힣\[0-9])", r"([다요죠음임])\s+(\[)", r"([.!?])\s+([가-힣\[0-9])"):
        text = f"regexp_replace({text}, {quoted(pattern)}, '\\1' || chr(1) || '\\2', 'g')"
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 12)"


def signals(text: str) -> str:
    return "[" + ", ".join(f"len(regexp_extract_all({text}, {quoted(p)}))" for p in vocab.LEGAL_PATTERNS) + "]"


def best_sentences(top: int) -> str:
    """Of the texts in n (doc_id, t), keys (doc_id, said): the ranks of sentences by Jaccard similarity, round after
    round until they barely change, and the best ones of these and the bonus in their order."""
    words = rf"list_distinct(list_filter(string_split_regex(s, '\s+'), lambda w: length(w) > 1 AND NOT list_contains({texts(vocab.STOPWORDS)}, w)))"
    hint = "(" + " OR ".join(f"contains(s, {quoted(h)})" for h in vocab.TERM_HINTS) + ")"
    return f"""cut_s AS (SELECT doc_id, {sentences("t")} AS ss FROM n),
        sent AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM cut_s),
        token AS (SELECT doc_id, i, unnest({words}) AS w FROM sent WHERE n > {top}),
        tokens AS (SELECT doc_id, i, count(*) AS k FROM token GROUP BY doc_id, i),
        common AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS c FROM token a JOIN token b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i <> b.i GROUP BY ALL),
        edge AS (SELECT c.doc_id, c.i, c.j, c.c / (x.k + y.k - c.c) AS v FROM common c JOIN tokens x ON x.doc_id = c.doc_id AND x.i = c.i JOIN tokens y ON y.doc_id = c.doc_id AND y.i = c.j),
        walk AS (
            SELECT doc_id, i, n, 1.0::DOUBLE / n AS score, 0 AS turn FROM sent WHERE n > {top}
            UNION ALL
            SELECT doc_id, i, n, fresh, turn + 1 FROM (
                SELECT doc_id, i, n, turn, fresh, bool_and(abs(score - fresh) <= 1e-6 + 1e-5 * abs(fresh)) OVER (PARTITION BY doc_id) AS done FROM (
                    SELECT a.doc_id, a.i, a.n, a.turn, a.score, 0.15::DOUBLE / a.n + 0.85::DOUBLE * coalesce(sum(e.v * b.score), 0) AS fresh
                    FROM walk a LEFT JOIN edge e ON e.doc_id = a.doc_id AND e.i = a.i LEFT JOIN walk b ON b.doc_id = e.doc_id AND b.i = e.j
                    GROUP BY a.doc_id, a.i, a.n, a.turn, a.score))
            WHERE NOT done AND turn < 30),
        last AS (SELECT doc_id, i, score FROM walk QUALIFY turn = max(turn) OVER (PARTITION BY doc_id)),
        scored AS (SELECT doc_id, i, s, round(ln(score + list_sum({signals("s")}) * 0.15::DOUBLE + CASE WHEN {hint} THEN 0.2::DOUBLE ELSE 0 END), 9) AS score FROM sent JOIN last USING (doc_id, i)),
        top AS (SELECT doc_id, i, s FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i DESC) <= {top} UNION ALL SELECT doc_id, i, s FROM sent WHERE n <= {top}),
        joined AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS said FROM top GROUP BY doc_id),
        keys AS (SELECT doc_id, coalesce(said, '') AS said FROM n LEFT JOIN joined USING (doc_id))"""


def key_sentences(source: str, top: int) -> str:
    return f"""WITH RECURSIVE {source}, n AS (SELECT doc_id, {NORMAL} AS t FROM kd), {best_sentences(top)} SELECT doc_id AS doc, said AS sentences FROM keys"""


WORDS = "words AS (SELECT doc_id, coalesce(phrases, '') AS phrases FROM n LEFT JOIN said USING (doc_id))"


def extraction(lines, top: int) -> str:
    """Phrases, sentences, domain and advice of composed documents."""
    hints = [(n, d, h) for n, (d, hs) in enumerate(vocab.DOMAIN_HINTS.items()) for h in hs]
    advice = [(d, list(ls)) for d, ls in vocab.STUDY_FOCUS.items()]
    return f"""{keyphrases(lines, composed(lines), last=WORDS)}, {best_sentences(top)}, {rows("hint", "n, domain, h", hints)}, {rows("advice", "domain, lines", advice)},
        x AS (SELECT doc_id, lower(t || ' ' || replace(phrases, ',', ' ')) AS t FROM n JOIN words USING (doc_id)),
        c AS (SELECT doc_id, domain, n, count(*) AS hits FROM x JOIN hint ON contains(t, h) GROUP BY ALL),
        b AS (SELECT doc_id, arg_min(domain, n - 100 * hits) AS domain, max(hits) AS hits FROM c GROUP BY doc_id),
        d AS (SELECT doc_id, phrases, said, CASE WHEN hits >= 2 THEN domain ELSE {quoted(vocab.GENERAL_DOMAIN)} END AS domain FROM words JOIN keys USING (doc_id) LEFT JOIN b USING (doc_id)),
        f AS (SELECT *, coalesce(nullif(array_to_string(string_split(phrases, ',')[1:4], ', '), ''), {quoted(vocab.NO_KEYWORDS)}) AS named,
          left(coalesce(nullif(trim(string_split(said, chr(10))[1]), ''), {quoted(vocab.NO_SENTENCE)}), 90) AS first FROM d)
        SELECT doc_id AS doc, phrases, md5(said) AS sentences, domain, array_to_string(list_transform(lines, lambda l: replace(replace(l, '{{0}}', first), '{{1}}', named)), '|') AS focus
        FROM f JOIN advice USING (domain)""".replace("WITH ", "WITH RECURSIVE ", 1)


def evaluation(lines, source: str, keys: str) -> str:
    """Samples and their measures; keys are the sentences that are kept."""
    return f"""{keyphrases(lines, source, last=WORDS)}, {keys},
        c AS (SELECT doc_id, phrases, said, {signals("t")} AS o, {signals("said")} AS k FROM n JOIN keys USING (doc_id) JOIN words USING (doc_id)),
        samples AS (SELECT doc_id::VARCHAR AS id, phrases AS keywords, md5(said) AS digest, length(said) AS n, array_to_string(o, ',') AS original, array_to_string(k, ',') AS summary,
          coalesce(round(list_sum(k) / nullif(list_sum(o), 0), 4), 0.0::DOUBLE) AS signal_retention FROM c)""".replace("WITH ", "WITH RECURSIVE ", 1)


def every_sentence() -> str:
    return f"keys AS (SELECT doc_id, array_to_string({sentences('t')}, chr(10)) AS said FROM n)"


SUMMARY = """SELECT count(*) AS samples, round(avg(signal_retention::DECIMAL(18,4)), 4) AS avg_signal_retention,
    round(avg(CASE WHEN keywords = '' THEN 0 ELSE len(string_split(keywords, ',')) END), 2) AS avg_keyword_count, round(avg(n), 2) AS avg_key_sentence_length FROM samples"""


def keyphrases(lines, source: str | None = None, last: str | None = None) -> str:
    endings = "|".join(sorted(set(vocab.ENDINGS), key=len, reverse=True))
    hints = "|".join(map(re.escape, vocab.TERM_HINTS))
    patterns = [p.replace("(대법원", "(?:대법원") for p in vocab.LEGAL_PATTERNS]
    found = " || ".join(f"regexp_extract_all(t, {quoted(p)})" for p in patterns)
    first = lambda source: f"SELECT doc_id, x, min(pos_) AS pos_ FROM (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos_ FROM {source}) GROUP BY doc_id, x"
    return f"""WITH {source or planted(lines)}, n AS (SELECT doc_id, {NORMAL} AS t FROM kd),
        h0 AS (SELECT doc_id, list_filter(list_transform({found}, lambda m: regexp_replace(m, '\\s+', '', 'g')), lambda m: length(m) > 1) AS xs FROM n),
        w0 AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[가-힣]{{2,14}}'), lambda w: CASE WHEN length(w) >= 3 THEN regexp_replace(w, '^(.{{2,}}?)(?:{endings})$', '\\1') ELSE w END) AS xs FROM n),
        w1 AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos_ FROM w0),
        w2 AS (SELECT doc_id, x, count(*) AS n, min(pos_) AS pos_ FROM w1 WHERE length(x) BETWEEN 2 AND 14 AND NOT list_contains({texts(vocab.STOPWORDS)}, x) GROUP BY doc_id, x),
        w3 AS (SELECT doc_id, x, pos_, n + CASE WHEN regexp_matches(x, '{hints}') THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(x, '({"|".join(vocab.LEGAL_SUFFIXES)})$') THEN 1 ELSE 0 END
                 - CASE WHEN regexp_matches(x, '({"|".join(vocab.VERB_RESTS)})$') THEN 0.5::DOUBLE ELSE 0 END AS score FROM w2),
        w4 AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos_) AS pos_ FROM w3),
        every AS (SELECT doc_id, x, pos_ FROM ({first("h0")}) UNION ALL SELECT doc_id, x, 1000000 + pos_ FROM w4 WHERE pos_ <= 20),
        one AS (SELECT doc_id, x, min(pos_) AS pos_ FROM every GROUP BY doc_id, x), cut AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos_) AS rank FROM one),
        said AS (SELECT doc_id, string_agg(x, ',' ORDER BY pos_) AS phrases FROM cut WHERE rank <= 10 GROUP BY doc_id)""" + (
        f", {last}" if last else " SELECT doc_id AS doc, coalesce(phrases, '') AS phrases FROM n LEFT JOIN said USING (doc_id)"
    )


def legal_signals(lines) -> str:
    counts = " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in vocab.LEGAL_PATTERNS)
    return f"WITH {planted(lines)} SELECT doc_id, ({counts})::BIGINT AS signals FROM kd"


def smart_truncated(limit: int = 120) -> str:
    least = max(20, limit // 3)
    ends = ", ".join(f"CASE WHEN contains(h, {quoted(e)}) THEN length(h) - instr(reverse(h), {quoted(e[::-1])}) + 1 ELSE 0 END" for e in vocab.CUT_ENDINGS)
    return f"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
        x AS (SELECT doc_id, t, left(t, {limit}) AS h FROM c), e AS (SELECT *, greatest({ends}) AS stop, length(h) - instr(reverse(h), ' ') AS gap FROM x)
        SELECT doc_id, CASE WHEN length(t) <= {limit} THEN t WHEN stop >= {least} THEN trim(left(h, stop)) WHEN gap >= {least} AND gap < length(h) THEN rtrim(left(h, gap)) || '…' ELSE rtrim(h) || '…' END AS short FROM e"""


def clean_lines(patterns, noise, key_length: int) -> str:
    plain = [p for p in patterns if "(?=" not in p]
    return f"""WITH l AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS pos_ FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\\n\\r\\x0B\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents)),
        t AS (SELECT doc_id, trim(raw) AS line, pos_, lower(regexp_replace(raw, '\\s', '', 'g')) AS key FROM l),
        k AS (SELECT * FROM t WHERE NOT (regexp_matches(line, {quoted("|".join(plain))}) OR (length(line) BETWEEN 1 AND 50 AND contains(line, 'portal.scourt.go.kr')) OR list_contains({texts(noise)}, line))),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos_) AS seen FROM k),
        j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos_) AS text FROM f WHERE seen = 1 OR length(key) < {key_length} GROUP BY doc_id)
        SELECT doc_id, sha256(coalesce(j.text, '')) AS digest, length(coalesce(j.text, ''))::BIGINT AS n FROM documents LEFT JOIN j USING (doc_id)"""


def blended_vectors(lines) -> str:
    """As ``blended``, with the cosine of mean word vectors."""
    return rf"""WITH {planted(lines)}, {ISSUE_ROWS},
        t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 1 AND NOT list_contains({texts(vocab.STOPWORDS)}, w)) AS ws FROM kd),
        p0 AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM kd),
        p1 AS (SELECT doc_id, word, count(*) AS n, ('0x' || left(md5(word), 6))::BIGINT % ((SELECT max(vec_id) FROM embeddings) + 1) AS vec_id FROM p0 WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[\p{{Nd}}\pP]+') GROUP BY ALL),
        p2 AS (SELECT doc_id, vec_id, sum(n) AS n FROM p1 GROUP BY ALL),
        p3 AS (SELECT doc_id, n, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS place FROM p2 JOIN embeddings USING (vec_id) WHERE embedding IS NOT NULL),
        p4 AS (SELECT doc_id, place, sum(x * n) AS x FROM p3 GROUP BY ALL), v AS (SELECT doc_id, list(x ORDER BY place) AS v FROM p4 GROUP BY doc_id HAVING sum(x * x) > 0),
        g AS (SELECT doc_id, list(k) AS ks FROM kd JOIN issue ON contains(text, k) GROUP BY doc_id),
        own AS (SELECT list_distinct(ws) AS ws, coalesce(ks, []) AS ks, v FROM t LEFT JOIN g USING (doc_id) LEFT JOIN v USING (doc_id) WHERE doc_id = (SELECT min(doc_id) FROM kd)),
        s AS (SELECT t.doc_id, coalesce(list_cosine_similarity(v.v, own.v), 0) AS cos,
                coalesce(len(list_intersect(list_distinct(t.ws), own.ws)) / nullif(len(list_distinct(t.ws || own.ws)), 0), 0) AS jac,
                coalesce(len(list_intersect(coalesce(g.ks, []), own.ks)) / nullif(len(own.ks), 0), 0) AS issue
              FROM t CROSS JOIN own LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id)),
        r AS (SELECT doc_id, round(round(0.65::DOUBLE * cos + 0.25::DOUBLE * jac + 0.10::DOUBLE * issue, 9), 6) AS score FROM s)
        SELECT doc_id, score FROM r WHERE score > 0.30"""


def blended(lines) -> str:
    return f"""WITH {planted(lines)}, {ISSUE_ROWS},
        t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({texts(vocab.STOPWORDS)}, w)) AS ws FROM kd),
        k AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM t), c AS (SELECT doc_id, len, term, count(*) AS n FROM k GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        w AS (SELECT doc_id, term, n / len * (ln(((SELECT count(*) FROM kd) + 1) / (df + 1)) + 1) AS weight FROM c JOIN f USING (term)),
        q AS (SELECT term, weight FROM w WHERE doc_id = (SELECT min(doc_id) FROM kd)),
        d AS (SELECT doc_id, sum(w.weight * coalesce(q.weight, 0)) AS dot, sqrt(sum(w.weight * w.weight)) AS norm FROM w LEFT JOIN q USING (term) GROUP BY doc_id),
        g AS (SELECT doc_id, list(k) AS ks FROM kd JOIN issue ON contains(text, k) GROUP BY doc_id),
        own AS (SELECT list_distinct(ws) AS ws, coalesce(ks, []) AS ks FROM t LEFT JOIN g USING (doc_id) WHERE doc_id = (SELECT min(doc_id) FROM kd)),
        s AS (SELECT t.doc_id, coalesce(dot / nullif(norm * (SELECT sqrt(sum(weight * weight)) FROM q), 0), 0) AS cos,
                coalesce(len(list_intersect(list_distinct(t.ws), own.ws)) / nullif(len(list_distinct(t.ws || own.ws)), 0), 0) AS jac,
                coalesce(len(list_intersect(coalesce(g.ks, []), own.ks)) / nullif(len(own.ks), 0), 0) AS issue
              FROM t CROSS JOIN own LEFT JOIN d USING (doc_id) LEFT JOIN g USING (doc_id)),
        r AS (SELECT doc_id, round(0.65::DOUBLE * cos + 0.25::DOUBLE * jac + 0.10::DOUBLE * issue, 6) AS score FROM s)
        SELECT doc_id, score FROM r WHERE score > 0.30"""
