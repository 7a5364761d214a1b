"""The same rows in SQL, for an engine whose regular expressions have no lookaround."""

from __future__ import annotations

import re

from ..functions import repair
from ..operators import cast, echoes, findings, lexical, messages, prose
from . import report
from .corpus import CONTENT
from .queries import BANNED, CAST, FORMS, PET_WORDS, REPAIRS, SPELLINGS

NL = "chr(10)"
C = f"c AS (SELECT doc_id AS n, {CONTENT} AS t FROM documents WHERE text IS NOT NULL)"
RAW = "c AS (SELECT doc_id AS n, text AS t FROM documents WHERE text IS NOT NULL)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(name: str, regex: str, source: str = "c", keys: str = "n", base: str = "0") -> str:
    """A CTE of all matches: keys, k, s, e, m."""
    return f"""{name}_a AS (SELECT {keys}, {base} AS base, regexp_extract_all(t, {q(regex)}) AS ms, string_split_regex(t, {q(regex)}) AS gs FROM {source}),
{name}_b AS (SELECT {keys}, base, unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM {name}_a),
{name} AS (SELECT {keys}, k, m, (base + sum(length(g) + length(m)) OVER w)::BIGINT AS e, (base + sum(length(g) + length(m)) OVER w - length(m))::BIGINT AS s
  FROM {name}_b WINDOW w AS (PARTITION BY {keys} ORDER BY k))"""


FRONT = r"(?s)\A\x{FEFF}?---\r?\n.*?\r?\n---\r?\n?"
SKIP = f"""{m("fence", "(?ms)^```[^\\n]*\\n.*?^```[ \\t]*\\r?\\n?")},
{m("head", "(?m)^#{1,6}[ \\t]+.*$")},
{m("brk", "(?m)^---[ \\t]*$")},
fm AS (SELECT n, t, length(regexp_extract(t, {q(FRONT)}))::BIGINT AS body FROM c),
sp0 AS (SELECT n, 0::BIGINT AS s, body AS e FROM fm WHERE body > 0 UNION ALL SELECT n, s, e FROM fence UNION ALL SELECT n, s, e FROM head UNION ALL SELECT n, s, e FROM brk),
sp1 AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY n ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM sp0),
sp2 AS (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM sp1),
skip AS (SELECT n, min(s) AS s, max(e) AS e FROM sp2 GROUP BY n, isl)"""
QUOTES = m("quo", '"[^"]*"')


def not_in(alias: str, spans: str = "skip") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {spans} x WHERE x.n = {alias}.n AND {alias}.s < x.e AND x.s < {alias}.e)"


def not_at(alias: str, spans: str = "quo") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {spans} x WHERE x.n = {alias}.n AND x.s <= {alias}.s AND {alias}.s < x.e)"


HEAD = "n AS chapter_number, s AS start, e AS \"end\""


def hit(rows: str, rule: str, replacement: str = "NULL::VARCHAR", text: str = "m") -> str:
    return f"SELECT {HEAD}, {rule} AS rule_id, {text} AS text, {replacement} AS replacement FROM {rows}"


DOUBLE = f"""{m("ds", " {2,}")},
double_space AS (SELECT ds.n, s, e, m FROM ds JOIN c USING (n) WHERE {not_in("ds")} AND s > 0 AND t[s] <> {NL} AND e < length(t) AND t[e + 1] NOT IN ({NL}, chr(13)))"""
TRAIL = f"""{m("tr0", "[ \\t]+(?:\\r?\\n|\\z)")},
tr1 AS (SELECT n, s, s + length(regexp_extract(m, '^[ \\t]+')) AS e, regexp_extract(m, '^[ \\t]+') AS m FROM tr0),
trail AS (SELECT * FROM tr1 WHERE {not_in("tr1")})"""
PUNCT = f"""{m("pu0", "[\\p{L}\\p{N}_] [,:;]")},
pu1 AS (SELECT n, s + 1 AS s, e, m[2:] AS m FROM pu0),
punct AS (SELECT * FROM pu1 WHERE {not_in("pu1")} AND {not_at("pu1")})"""
REPEATED = f"""{m("re0", "!{2,}")}, {m("re1", "[?]{2,}")},
re2 AS (SELECT n, s, e, m FROM re0 UNION ALL SELECT n, s, e, m FROM re1),
repeated AS (SELECT * FROM re2 WHERE {not_in("re2")})"""
DASH = f"""{m("da0", "—|-+")},
dash AS (SELECT n, s, e, m FROM da0 WHERE m IN ('—', '--') AND {not_in("da0")})"""


def _keep(text: str, new: str) -> str:
    return f"CASE WHEN {text}[1] = upper({text}[1]) AND {text}[1] <> lower({text}[1]) THEN upper({new}[1]) || {new}[2:] ELSE {new} END"


def _wordy() -> str:
    ctes, parts = [], []
    for i, (phrase, new, rule) in enumerate(lexical.WORDY):
        ctes.append(m(f"wo{i}", rf"(?i)\b{phrase}\b"))
        parts.append(f"SELECT n, s, e, m, {i} AS o, {q(rule)} AS rule, {q(new)} AS new FROM wo{i}")
    free = " UNION ALL ".join(parts)
    return ",\n".join(ctes) + f""",
wf AS (SELECT * FROM ({free}) y WHERE {not_in("y")} AND {not_at("y")}),
wordy AS (SELECT n, s, e, m, o, rule, CASE WHEN new = '' THEN '' ELSE {_keep("m", "new")} END AS rep FROM wf a
  WHERE NOT EXISTS (SELECT 1 FROM wf b WHERE b.n = a.n AND b.o < a.o AND a.s < b.e AND b.s < a.e))"""


WORDY = _wordy()


def edged(name: str, phrase: str, left: str, right: str, flags: str = "(?i)") -> str:
    """Matches of a phrase whose neighbours aren't of a class, found without lookaround: the phrase alone, then its neighbours."""
    return f"""{m(name + "_0", f"{flags}{phrase}")},
{name} AS (SELECT n, s, e, m FROM {name}_0 JOIN c USING (n) WHERE (s = 0 OR NOT regexp_matches(t[s], {q(left)})) AND (e = length(t) OR NOT regexp_matches(t[e + 1], {q(right)})))"""


def _earth() -> str:
    ctes, parts = [], []
    for i, term in enumerate(lexical.EARTH_TERMS):
        ctes.append(edged(f"ea{i}", re.escape(term).replace("\\ ", " "), "[A-Za-z]", "[A-Za-z]"))
        parts.append(f"SELECT n, s, e, m FROM ea{i}")
    union = " UNION ALL ".join(parts)
    return f"""WITH {C.replace("c AS (", "c0 AS (", 1)}, c AS (SELECT * FROM c0 WHERE NOT regexp_matches(t, {q(lexical.EARTH_CUES)})), {SKIP}, {", ".join(ctes)}
{hit(f"({union}) y WHERE {not_in('y')}", "'anachronism.earth_timeline'")}"""


WORDISH = r"[\p{L}\p{N}_]"


def _guide_ctes(phrases) -> tuple[str, str]:
    ctes = [edged(f"gu{i}", r"\s+".join(map(re.escape, p.split())), WORDISH, WORDISH) for i, p in enumerate(phrases)]
    return ", ".join(ctes), ""


def _banned() -> str:
    ctes, _ = _guide_ctes(BANNED)
    union = " UNION ALL ".join(f"SELECT n, s, e, m FROM gu{i}" for i in range(len(BANNED)))
    return f"WITH {C}, {SKIP}, {ctes} {hit(f'({union}) y WHERE {not_in("y")}', q('guide.banned'))}"


def _pets() -> str:
    ctes, _ = _guide_ctes(PET_WORDS)
    union = " UNION ALL ".join(f"SELECT n, s, e, m FROM (SELECT *, count(*) OVER (PARTITION BY n) AS uses FROM gu{i} WHERE {not_in(f'gu{i}')}) WHERE uses > {v}" for i, v in enumerate(PET_WORDS.values()))
    return f"WITH {C}, {SKIP}, {ctes} {hit(f'({union})', q('guide.pet_word'))}"


def _spelling() -> str:
    ctes, _ = _guide_ctes(SPELLINGS)

    def fixed(new: str) -> str:
        return f"CASE WHEN m = upper(m) AND m <> lower(m) AND length(m) > 1 THEN upper({q(new)}) ELSE {_keep('m', q(new))} END"

    union = " UNION ALL ".join(f"SELECT n, s, e, m, {fixed(new)} AS rep FROM gu{i} WHERE {not_in(f'gu{i}')}" for i, new in enumerate(SPELLINGS.values()))
    return f"WITH {C}, {SKIP}, {ctes} {hit(f'({union}) WHERE m <> rep', q('guide.spelling'), 'rep')}"


SCENES = f"""sc0 AS (SELECT brk.n, s, e FROM brk JOIN fm USING (n) WHERE s >= body UNION ALL SELECT n, length(t), length(t) FROM c),
sc1 AS (SELECT sc0.n, coalesce(lag(sc0.e) OVER (PARTITION BY sc0.n ORDER BY sc0.s, sc0.e), body) AS s, sc0.s AS e, t FROM sc0 JOIN fm USING (n)),
sc2 AS (SELECT n, s, e, regexp_matches(t[s + 1:e], '\\S') AS has_text, bool_or(regexp_matches(t[s + 1:e], '\\S')) OVER (PARTITION BY n) AS any_text, max(s) OVER (PARTITION BY n) AS last FROM sc1),
scene AS (SELECT n, s, e, row_number() OVER (PARTITION BY n ORDER BY s, e) AS scene FROM (SELECT DISTINCT n, s, e FROM sc2 WHERE has_text OR (NOT any_text AND s = last)))"""
PARAS = f"""{m("pb", "\\n\\s*\\n")},
pa0 AS (SELECT n, s, e FROM pb UNION ALL SELECT n, length(t), length(t) FROM c),
pa1 AS (SELECT pa0.n, coalesce(lag(pa0.e) OVER (PARTITION BY pa0.n ORDER BY pa0.s, pa0.e), 0)::BIGINT AS s, pa0.s::BIGINT AS e, t FROM pa0 JOIN c USING (n)),
para AS (SELECT n, s, e, t[s + 1:e] AS p FROM pa1 WHERE regexp_matches(t[s + 1:e], '\\S'))"""
#: Paragraphs of a prose segment are what lies between its blank lines, less line ends at the segment's edges.
SENTENCES = f"""{SCENES},
sg0 AS (SELECT n, s, e FROM skip UNION ALL SELECT n, length(t), length(t) FROM c),
sg AS (SELECT n, s, t[s + 1:e] AS t FROM (SELECT sg0.n, coalesce(lag(sg0.e) OVER (PARTITION BY sg0.n ORDER BY sg0.s, sg0.e), 0)::BIGINT AS s, sg0.s AS e, t FROM sg0 JOIN c USING (n)) WHERE e > s),
sg1 AS (SELECT n, s + length(regexp_extract(t, '^\\n*')) AS sg, regexp_replace(t, '^\\n+', '') AS t FROM sg),
{m("pc", "\\n[ \\t\\r]*\\n+", "sg1", "n, sg", "0")},
pd0 AS (SELECT n, sg, s, e FROM pc UNION ALL SELECT n, sg, length(t), length(t) FROM sg1),
pd1 AS (SELECT pd0.n, sg, coalesce(lag(pd0.e) OVER (PARTITION BY pd0.n, sg ORDER BY pd0.s, pd0.e), 0) AS a, pd0.s AS b, t FROM pd0 JOIN sg1 USING (n, sg)),
pd AS (SELECT n, sg + a AS p, t[a + 1:b] AS t FROM pd1 WHERE regexp_matches(t[a + 1:b], '\\S')),
{m("gp", "[.!?][\"”’)]*\\s+", "pd", "n, p", "0")},
se0 AS (SELECT n, p, e AS nx, s + length(regexp_replace(m, '\\s+$', '')) AS e FROM gp UNION ALL SELECT n, p, length(t), length(t) FROM pd),
se1 AS (SELECT se0.n, p, coalesce(lag(nx) OVER (PARTITION BY se0.n, p ORDER BY nx, e), 0) AS a, e AS b, t FROM se0 JOIN pd USING (n, p)),
se2 AS (SELECT n, p + a + length(regexp_extract(t[a + 1:b], '^\\s*')) AS s, regexp_replace(t[a + 1:b], '^\\s+|\\s+$', '', 'g') AS x FROM se1 WHERE b > a),
sent AS (SELECT se2.n, row_number() OVER (PARTITION BY se2.n ORDER BY se2.s) - 1 AS idx, se2.s::BIGINT AS s, (se2.s + length(x))::BIGINT AS e, coalesce(scene.scene, 1)::BIGINT AS scene,
  regexp_matches(x, '["“”]') AS dialogue, x FROM se2 LEFT JOIN scene ON scene.n = se2.n AND scene.s <= se2.s AND se2.s < scene.e WHERE x <> '')"""
SHAPES = f"{SENTENCES}, sh AS (SELECT *, len(regexp_extract_all(x, {q(prose_word := "[A-Za-z0-9'']+".replace("''", "'"))}))::BIGINT AS words, lower(regexp_extract(x, {q(prose_word)})) AS opener FROM sent)"
RUNS = f"""{SHAPES},
ru0 AS (SELECT *, CASE WHEN NOT dialogue AND opener <> '' THEN opener END AS key FROM sh),
ru1 AS (SELECT *, coalesce(key = lag(key) OVER w AND scene = lag(scene) OVER w, false) AS same FROM ru0 WINDOW w AS (PARTITION BY n ORDER BY idx)),
ru2 AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY n ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM ru1),
runs AS (SELECT n, min(s) AS s, max(e) AS e, min(key) AS opener, count(*) AS sentences FROM ru2 WHERE key IS NOT NULL GROUP BY n, run HAVING count(*) >= 3)"""
METRICS = f"""{SHAPES},
me0 AS (SELECT n, scene, count(*) AS narration, avg(words) AS mean_words, stddev_pop(words) AS deviation, min(s) AS s, max(e) AS e FROM sh WHERE NOT dialogue GROUP BY n, scene),
me1 AS (SELECT n, scene, opener, count(*) AS uses, min(idx) AS met FROM sh WHERE NOT dialogue AND opener <> '' GROUP BY n, scene, opener),
me2 AS (SELECT * FROM me1 QUALIFY row_number() OVER (PARTITION BY n, scene ORDER BY uses DESC, met) = 1),
me3 AS (SELECT n, scene, narration, mean_words, CASE WHEN mean_words > 0 THEN deviation / mean_words ELSE 0.0::DOUBLE END AS spread, coalesce(opener, '') AS top_opener, coalesce(uses, 0)::DOUBLE / narration AS top_share, s, e FROM me0 LEFT JOIN me2 USING (n, scene)),
metrics AS (SELECT *, round_even(100 * (least(spread / {prose.TARGET_SPREAD}::DOUBLE, 1) + least(mean_words / {prose.TARGET_MEAN}::DOUBLE, 1) + (1 - least(greatest(top_share - 0.1::DOUBLE, 0) / 0.3::DOUBLE, 1))) / 3, 0)::BIGINT AS variety FROM me3)"""


def _weak(min_words: int, more: str = "", every: bool = False) -> str:
    quoted = q('"[^"]*"|“[^”]*”')
    names = ", ".join(map(q, prose.NOT_NAMES))
    adverbs = ", ".join(map(q, prose.NOT_ADVERBS))
    limits = " ".join(f"WHEN {q(k)} THEN {-1 if every else v}" for k, v in prose.WEAK_LIMITS.items())
    return f"""WITH {C}, {SKIP}, {SHAPES},
told AS (SELECT n, idx, scene, s AS base, x AS t FROM sent WHERE NOT dialogue),
sp_a AS (SELECT n, idx, scene, s AS base, regexp_extract_all(x, {quoted}) AS qs, string_split_regex(x, {quoted}) AS gs FROM sent WHERE dialogue),
spoken AS (SELECT n, idx, scene, base, array_to_string(list_transform(range(len(gs)), lambda i: gs[i + 1] || coalesce(repeat(chr(1), length(qs[i + 1])), '')), '') AS t FROM sp_a),
{m("wa", prose.QUALIFIER, "told", "n, idx, scene", "base")},
{m("wb", prose.FILTER, "told", "n, idx, scene", "base")},
{m("wc", prose.TAG_ADVERB, "spoken", "n, idx, scene", "base")},
wd AS (SELECT *, regexp_extract(m, {q(prose.TAG_ADVERB)}, 1) AS one, regexp_extract(m, {q(prose.TAG_ADVERB)}, 2) AS two FROM wc),
al0 AS (SELECT n, scene, 'weak.qualifier' AS r, s, e, m AS own FROM wa
  UNION ALL SELECT n, scene, 'weak.filter_word', e - length(regexp_extract(m, {q(prose.FILTER)}, 2)), e, regexp_extract(m, {q(prose.FILTER)}, 2) FROM wb WHERE regexp_extract(m, {q(prose.FILTER)}, 1) NOT IN ({names})
  UNION ALL SELECT n, scene, 'weak.tag_adverb', CASE WHEN one <> '' THEN e - length(one) ELSE s END, CASE WHEN one <> '' THEN e ELSE s + length(two) END, CASE WHEN one <> '' THEN one ELSE two END FROM wd
    WHERE lower(CASE WHEN one <> '' THEN one ELSE two END) NOT IN ({adverbs})),
al AS (SELECT *, lower(own) AS word FROM al0),
tot AS (SELECT n, scene, sum(words) AS words FROM sh GROUP BY n, scene),
rate AS (SELECT al.*, words, 1000.0 * count(*) OVER (PARTITION BY al.n, al.scene, r) / words AS rate FROM al JOIN tot USING (n, scene))
SELECT n AS chapter_number, scene, r AS rule_id, s AS start, e AS "end", word{more} FROM rate WHERE words >= {min_words} AND rate > CASE r {limits} END"""


STOPS = ", ".join(map(q, echoes.STOP_WORDS))
ECHO = f"""WITH {RAW}, {SKIP}, {m("tk", "[A-Za-z'']+".replace("''", "'"))},
w0 AS (SELECT n, s, e, lower(m) AS word FROM tk WHERE {not_in("tk")} AND length(m) >= 3 AND lower(m) NOT IN ({STOPS})),
w1 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s) AS i FROM w0),
w2 AS (SELECT *, count(*) OVER (PARTITION BY n, word ORDER BY i RANGE BETWEEN 39 PRECEDING AND CURRENT ROW) AS uses, coalesce(i - lag(i) OVER (PARTITION BY n, word ORDER BY i) > 40, true)::INT AS fresh FROM w1),
w3 AS (SELECT *, sum(fresh) OVER (PARTITION BY n, word ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM w2)
SELECT n AS chapter_number, i, s AS start, e AS "end", word, uses AS n FROM w3 WHERE uses >= 3 QUALIFY row_number() OVER (PARTITION BY w3.n, word, cluster ORDER BY i) = 1"""


def _phrases() -> str:
    parts = []
    for n in (4, 3):
        gram = ", ".join(["word", *(f"lead(word, {j}) OVER w" for j in range(1, n))])
        parts.append(f"SELECT n, ps, s, p, [{gram}] AS gram, lead(e, {n - 1}) OVER w AS e, {n} AS size FROM tw WINDOW w AS (PARTITION BY n, ps ORDER BY s)")
    return f"""WITH {RAW}, {SKIP}, {PARAS}, {m("tk", "[A-Za-z'']+".replace("''", "'"))},
tw AS (SELECT tk.n, para.s AS ps, tk.s, tk.e, lower(m) AS word, row_number() OVER (PARTITION BY tk.n, para.s ORDER BY tk.s) AS p FROM tk JOIN para ON para.n = tk.n AND para.s <= tk.s AND tk.s < para.e WHERE {not_in("tk")}),
gr AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE e IS NOT NULL),
pr AS (SELECT n, ps, s, p, gram, size, lead(p) OVER w - p - size AS gap, lead(e) OVER w AS e2, min(p) OVER (PARTITION BY n, ps, size, gram) AS met FROM gr WINDOW w AS (PARTITION BY n, ps, size, gram ORDER BY p))
SELECT n AS chapter_number, ps AS para, array_to_string(gram, ' ') AS phrase, gap, s AS start, e2 AS "end" FROM pr
WHERE gap <= 2 AND len(list_filter(gram, lambda x: length(x) > 2 AND x NOT IN ({STOPS}))) > 0
QUALIFY row_number() OVER (PARTITION BY n, ps ORDER BY size DESC, gap, met, p) = 1"""


def _case(column: str, at: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({column}, {q(r[0])}) THEN {q(r[at])}" for r in findings.RULES) + " END"


FINDINGS = f"""{C}, {SKIP}, {QUOTES}, {DOUBLE}, {TRAIL}, {PUNCT}, {REPEATED}, {DASH}, {WORDY},
fi0 AS (SELECT n, s, e, 0 AS o, 0 AS turn, 'mech.double_space' AS r, m, ' ' AS rep FROM double_space UNION ALL SELECT n, s, e, 1, 0, 'mech.trailing_ws', m, '' FROM trail
  UNION ALL SELECT n, s, e, 2, 0, 'mech.space_before_punct', m, m[2:] FROM punct UNION ALL SELECT n, s, e, 3, starts_with(m, '?')::INT, 'mech.repeated_punct', m, NULL FROM repeated
  UNION ALL SELECT n, s, e, 4, 0, 'style.em_dash', m, NULL FROM dash UNION ALL SELECT n, s, e, 5, o, rule, m, rep FROM wordy),
fi1 AS (SELECT *, {_case("r", 1)} AS category, {_case("r", 2)} AS severity, row_number() OVER (PARTITION BY n ORDER BY o, turn, s, e, r, m) AS seq FROM fi0),
fi AS (SELECT *, 'det-c' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '-' || CASE WHEN seq < 10000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END AS id FROM fi1)"""
RANK = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(findings.SEVERITIES)) + " END"


#: The names by which the members of CAST are known, as the rules for tokens have it.
TOKENS = {"Garrick Vale": ("Garrick Vale", "Garrick"), "Mara": ("Mara",), "Of Stone": ("Of Stone", "Stone"), "Lee Vale": ("Lee Vale", "Lee")}


def _canon(more: str = "") -> str:
    parts = []
    for name, pronouns in CAST:
        nouns = cast.NOUNS_AGAINST.get({"he/him": cast.HE, "she/her": cast.SHE}.get(pronouns))
        if nouns is None:
            continue
        said = rf"{cast.DETERMINER}\s+{cast.ADJECTIVES}\b({'|'.join(nouns)})"
        found = []
        for token in TOKENS[name]:
            tied = rf"\b{token}(?:'s)?\s*,\s*{said}\b", rf"\b{token}\s+{cast.LINKS}\s+{said}\b", rf"{said}\s*,?\s+{token}\b"
            found += [f"regexp_extract_all(x, {q('(?i)' + p)}, 1)" for p in tied]
        parts.append(f"SELECT n, k, {q(name)} AS name, {q(pronouns)} AS pronouns, x, list_transform(flatten([{', '.join(found)}]), lambda w: lower(w)) AS nouns FROM cs")
    return f"""WITH {C}, {m("cg", "[.!?]\\s+", "(SELECT n, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM c)")},
ct AS (SELECT n, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM c),
c0 AS (SELECT n, s + 1 AS b, e AS nx FROM cg UNION ALL SELECT n, length(t), length(t) FROM ct),
c1 AS (SELECT c0.n, coalesce(lag(nx) OVER (PARTITION BY c0.n ORDER BY nx, b), 0) AS a, b, t FROM c0 JOIN ct USING (n)),
cs AS (SELECT n, t[a + 1:b] AS x, min(a) AS k FROM c1 WHERE t[a + 1:b] <> '' GROUP BY n, t[a + 1:b]),
tied AS ({" UNION ALL ".join(parts)})
SELECT n AS chapter_number, name, x AS sentence{more} FROM tied WHERE len(nouns) > 0"""


FORMS_SQL = ", ".join(f"({q(re.sub(' +', ' ', f.strip().lower()))}, {q(re.escape(f.strip().lower()))})" for f in FORMS)
MARK = f"{NL} || '…' || {NL}"
AGREE = q(findings.AGREEMENT)
STRIPPED = r"regexp_replace(p, '^\s+|\s+$', '', 'g')"

SQL: dict[str, str] = {
    "echo_local_repeat": ECHO,
    "chapter_scan": f"""WITH {C} SELECT n AS chapter_number, coalesce(trim(trim(list_filter(string_split(t, {NL}), lambda x: starts_with(trim(x), '# '))[1])[3:]), 'chapter-' || n) AS title,
  length(t)::BIGINT AS n_chars, len(string_split(t, {NL}))::BIGINT AS n_lines FROM c""",
    "match_offsets": f"WITH {C}, {m('x', ' {2,}')} SELECT n AS chapter_number, k::INT AS k, s AS start, e AS \"end\" FROM x",
    "non_prose_spans": f"WITH {C}, {SKIP} SELECT {HEAD} FROM skip",
    "scene_spans": f"WITH {C}, {SKIP}, {SCENES} SELECT n AS chapter_number, scene, s::BIGINT AS start, e::BIGINT AS \"end\" FROM scene",
    "quote_spans": f"WITH {C}, {QUOTES} SELECT {HEAD} FROM quo",
    "paragraphs": f"WITH {C}, {PARAS} SELECT {HEAD} FROM para",
    "sentences_fallback": f"WITH {C}, {SKIP}, {SENTENCES} SELECT n AS chapter_number, idx::BIGINT AS idx, s AS start, e AS \"end\", scene, dialogue, x AS text FROM sent",
    "mech_double_space": f"WITH {C}, {SKIP}, {DOUBLE} {hit('double_space', q('mech.double_space'), q(' '))}",
    "mech_trailing_ws": f"WITH {C}, {SKIP}, {TRAIL} {hit('trail', q('mech.trailing_ws'), q(''))}",
    "mech_space_before_punct": f"WITH {C}, {SKIP}, {QUOTES}, {PUNCT} {hit('punct', q('mech.space_before_punct'), 'm[2:]')}",
    "mech_repeated_punct": f"WITH {C}, {SKIP}, {REPEATED} {hit('repeated', q('mech.repeated_punct'))}",
    "style_em_dash": f"WITH {C}, {SKIP}, {DASH} {hit('dash', q('style.em_dash'))}",
    "anachronism": _earth(),
    "wordiness": f"WITH {C}, {SKIP}, {QUOTES}, {WORDY} {hit('wordy', 'rule', 'rep')}",
    "echo_phrase_dup": _phrases(),
    "rhythm_opener_run": f"WITH {C}, {SKIP}, {RUNS} SELECT {HEAD}, opener, sentences FROM runs",
    "scene_metrics": f"WITH {C}, {SKIP}, {METRICS} SELECT n AS chapter_number, scene, narration, mean_words, spread, top_opener, top_share, variety FROM metrics",
    "rhythm_flat_scene": f"WITH {C}, {SKIP}, {METRICS} SELECT n AS chapter_number, scene, variety, s AS start, e AS \"end\" FROM metrics WHERE narration >= {prose.MIN_SENTENCES} AND variety < {prose.FLAT_VARIETY}",
    "weakeners": _weak(prose.MIN_SCENE_WORDS),
    "guide_banned": _banned(),
    "guide_pet_word": _pets(),
    "guide_spelling": _spelling(),
    "hollow_shapes": f"""WITH {C}, {SKIP}, {SENTENCES}, ho AS (SELECT *, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS f FROM sent WHERE NOT dialogue),
hp AS (SELECT *, CASE WHEN regexp_matches(f, {q(prose.NARROW)}) THEN 'narrow' WHEN regexp_matches(f, {q(prose.TAIL)}) THEN 'tail' END AS pattern FROM ho)
SELECT {HEAD}, pattern FROM hp WHERE pattern IS NOT NULL""",
    # Whole words: what stands round a form is looked at, in the text with a space at both ends.
    "lexicon_filter": f"""WITH {FINDINGS}, fo(f, rx) AS (VALUES {FORMS_SQL})
SELECT {HEAD}, r AS rule_id FROM fi WHERE NOT EXISTS (SELECT 1 FROM fo WHERE lower(trim(regexp_replace(m, '\\s+', ' ', 'g'))) = f OR (coalesce(rep, '') <> ''
  AND regexp_matches(' ' || m || ' ', '(?i)[^\\p{{L}}\\p{{N}}_]' || rx || '[^\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(' ' || rep || ' ', '(?i)[^\\p{{L}}\\p{{N}}_]' || rx || '[^\\p{{L}}\\p{{N}}_]')))""",
    "canon_pronoun_prose": _canon(),
    "finding_ids": f"WITH {FINDINGS} SELECT id, n AS chapter_number, r AS rule_id, s AS start, e AS \"end\" FROM fi",
    "positions": f"""WITH {C}, {SKIP}, {DASH}, {SENTENCES}
SELECT d.n AS chapter_number, d.s AS start, d.e AS "end", scene.scene AS scene, a.s AS sentence_start, coalesce(b.e, a.e) AS sentence_end FROM dash d
LEFT JOIN scene ON scene.n = d.n AND scene.s <= d.s AND d.s < scene.e LEFT JOIN sent a ON a.n = d.n AND a.s <= d.s AND d.s < a.e
LEFT JOIN sent b ON b.n = d.n AND b.s <= greatest(d.e - 1, d.s) AND greatest(d.e - 1, d.s) < b.e""",
    "summary_grouping_sets": f"""WITH {FINDINGS}, fg AS (SELECT *, 'deterministic' AS engine FROM fi)
SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM fg GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM fg GROUP BY category
UNION ALL SELECT 'engine', engine, count(*) FROM fg GROUP BY engine UNION ALL SELECT 'total', '', count(*) FROM fg""",
    "chapter_rollup": f"WITH {FINDINGS} SELECT n AS chapter_number, count(*) AS n, string_agg(id, ',' ORDER BY seq) AS finding_ids FROM fi WHERE category NOT IN ('echo', 'rhythm', 'weakener', 'hollow') GROUP BY fi.n",
    "terminal_topk": f"WITH {FINDINGS} SELECT id, severity, category, n AS chapter_number, s AS start FROM fi ORDER BY {RANK}, category, n, s, id LIMIT 50",
    # These edits never overlap, so that nothing has to be resolved here.
    "apply_edits": f"""WITH {FINDINGS}, ed AS (SELECT n, s, e, t[coalesce(lag(e) OVER (PARTITION BY n ORDER BY s), 0) + 1:s] || rep AS piece, t FROM fi JOIN c USING (n) WHERE rep IS NOT NULL),
ea AS (SELECT n, string_agg(piece, '' ORDER BY s) || any_value(t)[max(e) + 1:] AS content, count(*) AS applied FROM ed GROUP BY n)
SELECT c.n AS chapter_number, coalesce(content, t) AS content, coalesce(applied, 0) AS applied FROM c LEFT JOIN ea USING (n)""",
    "truncate_middle": f"WITH {RAW} SELECT n AS chapter_number, CASE WHEN length(t) > 2000 THEN t[:998] || {MARK} || right(t, 999) ELSE t END AS content FROM c",
}


def _place(words: list[str], text: str = "text") -> str:
    """The place of a hit's text among words, in lower case and with single spaces."""
    return f"list_position([{', '.join(q(w.lower()) for w in words)}], regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


def _all_rules(every: bool = False) -> str:
    """Every rule's hits, as chapter_number, rule_ord, rule_id, start, end, replacement, word, text, turn, note; with every, all weak words count and no scene is flat."""
    phrases = SQL["echo_phrase_dup"].replace(RAW, C)
    turns = {"mech_repeated_punct": "starts_with(text, '?')::INT", "anachronism": _place(lexical.EARTH_TERMS), "wordiness": _place([p for p, _, _ in lexical.WORDY])}
    guide = {"guide_banned": _place(BANNED), "guide_pet_word": _place(list(PET_WORDS)), "guide_spelling": _place(list(SPELLINGS))}
    pet = f"'“' || [{', '.join(map(q, PET_WORDS))}][{guide['guide_pet_word']}] || '” appears ' || count(*) OVER (PARTITION BY chapter_number, {guide['guide_pet_word']}) || ' times in this chapter (limit ' || [{', '.join(map(str, PET_WORDS.values()))}][{guide['guide_pet_word']}] || ').'"
    weak = "CASE rule_id " + " ".join(f"WHEN {q(r)} THEN replace({q(messages.WEAK[r])}, '{{word}}', own) || ' Scene ' || scene || ': ' || printf('%.1f', rate) || ' per 1,000 words (limit {limit:g}).'" for r, limit in prose.WEAK_LIMITS.items()) + " END"
    flat = f"'Scene ' || scene || ' reads flat: variety ' || variety || '/100 (limit {prose.FLAT_VARIETY}). Average ' || printf('%.1f', mean_words) || ' words; n/a of sentences open subject-then-verb.'"
    parts = [
        *(f"SELECT chapter_number, {i} AS rule_ord, rule_id, start, \"end\", replacement, NULL::VARCHAR AS word, text, {turns.get(name, 0)} AS turn, NULL::VARCHAR AS note FROM ({SQL[name]})" for i, name in enumerate(
            ["mech_double_space", "mech_trailing_ws", "mech_space_before_punct", "mech_repeated_punct", "style_em_dash", "anachronism", "wordiness"])),
        f"SELECT chapter_number, 7, 'echo.local_repeat', start, \"end\", NULL, word, NULL, 0, 'Word ' || chr(39) || word || chr(39) || ' repeats ' || n || ' times within 40 content words.' FROM ({SQL['echo_local_repeat'].replace(RAW, C)})",
        f"SELECT p.chapter_number, 8, 'echo.phrase_dup', p.start, p.\"end\", NULL, NULL, regexp_replace(x.p, '^\\s+|\\s+$', '', 'g'), 0, 'Phrase ' || chr(39) || phrase || chr(39) || ' appears twice in close proximity within the same paragraph — likely a polish-pass stutter.' FROM ({phrases}) p JOIN (WITH {C}, {PARAS} SELECT * FROM para) x ON x.n = p.chapter_number AND x.s = p.para",
        f"SELECT chapter_number, 9, 'rhythm.same_opener_run', start, \"end\", NULL, NULL, NULL, 0, sentences || ' sentences in a row start with “' || opener || '”.' FROM ({SQL['rhythm_opener_run']})",
        f"SELECT n, 10, 'rhythm.flat_scene', s, e, NULL, NULL, NULL, scene, {flat} FROM (WITH {C}, {SKIP}, {METRICS} SELECT * FROM metrics WHERE narration >= {1_000_000_000 if every else prose.MIN_SENTENCES} AND variety < {prose.FLAT_VARIETY})",
        f"SELECT chapter_number, 11, rule_id, start, \"end\", NULL, NULL, own, scene * 3 + list_position([{', '.join(map(q, sorted(prose.WEAK_LIMITS)))}], rule_id), {weak} FROM ({_weak(0 if every else prose.MIN_SCENE_WORDS, ', own, rate', every)})",
        *(f"SELECT chapter_number, {12 + i}, rule_id, start, \"end\", replacement, NULL, text, {guide[name]}, {pet if name == 'guide_pet_word' else 'NULL'} FROM ({SQL[name]})" for i, name in enumerate(guide)),
    ]
    return " UNION ALL ".join(parts)


def _placed(every: bool = False) -> str:
    """Every rule's hits in their places, as CTEs up to placed."""
    flat = "trim(regexp_replace(own, '\\s+', ' ', 'g'))"
    line = lambda at: f"len(string_split(t[:{at}], {NL}))::BIGINT"
    return f"""WITH {C}, {SKIP}, {SENTENCES}, every AS ({_all_rules(every)}),
lo0 AS (SELECT v.* EXCLUDE (chapter_number, start, "end"), v.chapter_number AS n, start AS s, "end" AS e, t, rule_id = 'echo.local_repeat' AS wide FROM every v JOIN c ON c.n = v.chapter_number),
lo1 AS (SELECT * EXCLUDE (s, e), CASE WHEN wide THEN s - length(regexp_extract(t[:s], '[^.!?\n]*$')) ELSE s END AS s, CASE WHEN wide THEN e + length(regexp_extract(t[e + 1:], '^[^.!?\n]*[.!?]?')) ELSE e END AS e FROM lo0),
lo2 AS (SELECT * EXCLUDE (s), CASE WHEN wide THEN s + length(regexp_extract(t[s + 1:e], '^[ \t]*')) ELSE s END AS s FROM lo1),
lo3 AS (SELECT *, t[s + 1:e] AS own, greatest(e - 1, s) AS z FROM lo2),
placed AS (SELECT d.n, d.rule_ord, d.turn, d.rule_id, d.s::BIGINT AS s, d.e::BIGINT AS e, d.replacement, d.note, d.word,
  CASE WHEN rule_id LIKE 'rhythm.%' THEN CASE WHEN length({flat}) > 160 THEN {flat}[:159] || '…' ELSE {flat} END
       WHEN wide THEN regexp_replace(own, '^\\s+|\\s+$', '', 'g') ELSE coalesce(text, own) END AS excerpt,
  {line("d.s")} AS line_start, {line("d.z")} AS line_end, coalesce(scene.scene, -1) AS scene, coalesce(a.s, -1) AS sentence_start, coalesce(b.e, a.e, -1) AS sentence_end
FROM lo3 d LEFT JOIN scene ON scene.n = d.n AND scene.s <= d.s AND d.s < scene.e
LEFT JOIN sent a ON a.n = d.n AND a.s <= d.s AND d.s < a.e LEFT JOIN sent b ON b.n = d.n AND b.s <= d.z AND d.z < b.e)"""


def _locations() -> str:
    return f'{_placed()} SELECT n AS chapter_number, rule_id, s AS start, e AS "end", excerpt, line_start, line_end, scene, sentence_start, sentence_end FROM placed'


def _said(texts: dict[str, str]) -> str:
    def text(pattern: str) -> str:
        return f"replace(replace(replace({q(pattern)}, '{{old}}', coalesce(excerpt, '')), '{{new}}', coalesce(replacement, '')), '{{mark}}', excerpt[1])"

    return "CASE " + " ".join(f"WHEN rule_id = {q(rule)} THEN {text(pattern)}" for rule, pattern in texts.items()) + " END"


def _message() -> str:
    wordy = f"CASE WHEN coalesce(replacement, '') = '' THEN replace({q(messages.DROP)}, '{{old}}', excerpt) ELSE replace(replace({q(messages.PREFER)}, '{{new}}', replacement), '{{old}}', excerpt) END"
    return f"coalesce(note, CASE WHEN rule_id LIKE 'word.%' THEN {wordy} ELSE {_said(messages.MESSAGES)} END)"


ID = "'det-c' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '-' || CASE WHEN seq < 10000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END"
NUMBERED = "row_number() OVER (PARTITION BY n ORDER BY rule_ord, turn, s NULLS FIRST, e NULLS FIRST, rule_id, excerpt, message) AS seq"


def deduped(rows: str, keys: str = "id") -> str:
    """CTEs from rows (n, category, seq, s, e, message) to kept: the fold over each category of a chapter; those without a place by their messages."""
    same = "2 * greatest(0, least(x[1].e, k.e) - greatest(x[1].s, k.s)) >= greatest(x[1].e, k.e) - least(x[1].s, k.s) OR (x[1].s >= k.s AND x[1].e <= k.e) OR (k.s >= x[1].s AND k.e <= x[1].e)"
    return f"""fold AS (SELECT n, category, list_reduce(list([{{'s': s, 'e': e, 'seq': seq}}] ORDER BY seq),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: greatest(x[1].e, k.e) > least(x[1].s, k.s) AND ({same}))) = 0 THEN list_concat(acc, x) ELSE acc END) AS stays FROM {rows} WHERE s IS NOT NULL GROUP BY n, category),
stay AS (SELECT n, category, unnest(list_transform(stays, lambda k: k.seq)) AS seq FROM fold),
kept AS (SELECT r.* FROM {rows} r JOIN stay USING (n, category, seq) UNION ALL
  SELECT * FROM {rows} WHERE s IS NULL QUALIFY row_number() OVER (PARTITION BY n, category, lower(trim(regexp_replace(message, '\\s+', ' ', 'g'))) ORDER BY seq) = 1)"""


def _check() -> str:
    canon = _canon(", k, list_filter(nouns, lambda w, i: list_position(nouns, w) = i) AS nouns, pronouns")
    return f"""{_placed()}, clash AS ({canon}),
ch0 AS (SELECT * EXCLUDE (word), {_message()} AS message FROM placed WHERE rule_id <> 'echo.local_repeat' AND rule_id NOT LIKE 'guide.%'
  UNION ALL SELECT chapter_number, 20, k, 'canon.pronoun_prose', NULL, NULL, NULL, NULL, CASE WHEN length(sentence) > 280 THEN sentence[:279] || '…' ELSE sentence END, -1, -1, -1, -1, -1,
    name || ' is ' || pronouns || ' in the character file, but this sentence also says ' || array_to_string(nouns, ', ') || '.' FROM clash),
ch1 AS (SELECT *, {_case("rule_id", 1)} AS category, {NUMBERED} FROM ch0), {deduped("ch1")}
SELECT {ID} AS id, n AS chapter_number, rule_id, coalesce(s, -1) AS start, coalesce(e, -1) AS "end", line_start, line_end, scene, sentence_start, sentence_end FROM kept"""


def _rewrites() -> str:
    """Units of flagged paragraphs, their edits, and the gates; the rules run over the chapters as they are and over each chapter with an edit in its place."""
    words = lambda x: f"len(regexp_extract_all({x}, '[A-Za-z0-9'']+'))"
    edged = lambda x, name: f"regexp_matches(' ' || {x} || ' ', '(?i)[^\\p{{L}}\\p{{N}}_]{name}[^\\p{{L}}\\p{{N}}_]')"
    quoted = lambda x: f"regexp_extract_all({x}, {q(prose.QUOTED)})"
    blocks = lambda x: f"len(regexp_extract_all({x}, '[^\\n]+(?:\\n[^\\n]+)*'))"
    before, after = (f"{_placed(True).replace(C, of)} SELECT n, rule_id, s, e FROM placed" for of in (C, "c AS (SELECT key AS n, t FROM edited)"))
    return f"""WITH {C}, {m("bl", "[^\\n]+(?:\\n[^\\n]+)*")}, hits AS ({_placed()} SELECT * FROM placed WHERE rule_id <> 'echo.local_repeat'),
no AS (SELECT * FROM hits WHERE rule_id LIKE 'rhythm.s%_run' OR rule_id LIKE 'weak.%' OR rule_id LIKE 'hollow.%'),
u0 AS (SELECT r.n, bl.k AS para, bl.s, bl.e, count(*) AS hits FROM no r JOIN bl ON bl.n = r.n AND bl.s <= r.s AND r.s < bl.e WHERE regexp_matches(bl.m, '[A-Za-z0-9'']') AND NOT starts_with(regexp_replace(bl.m, '^\\s+', ''), '#') GROUP BY r.n, bl.k, bl.s, bl.e),
u1 AS (SELECT *, para - row_number() OVER (PARTITION BY n ORDER BY para) AS isl FROM u0),
u2 AS (SELECT *, (row_number() OVER (PARTITION BY n, isl ORDER BY para) - 1) // 2 AS unit FROM u1),
u3 AS (SELECT n, min(s) AS s, max(e) AS e, sum(hits) AS hits FROM u2 GROUP BY n, isl, unit),
u4 AS (SELECT * FROM u3 QUALIFY row_number() OVER (PARTITION BY n ORDER BY hits DESC, s) <= 8),
u5 AS (SELECT u4.*, u4.n * 1000000 + u4.s AS key, c.t, c.t[u4.s + 1:u4.e] AS old, regexp_replace(replace(c.t[u4.s + 1:u4.e], ' very ', ' '), '^\\s+|\\s+$', '', 'g') AS new FROM u4 JOIN c USING (n)),
u6 AS (SELECT *, CASE WHEN new = '' THEN 'writer_unreadable' WHEN trim(regexp_replace(new, '\\s+', ' ', 'g')) = trim(regexp_replace(old, '\\s+', ' ', 'g')) THEN 'unchanged'
  WHEN {words("new")} = 0 THEN 'empty' WHEN {words("new")} < 0.25 * {words("old")} OR {words("new")} > 1.4 * {words("old")} THEN 'length' WHEN {quoted("old")} <> {quoted("new")} THEN 'dialogue'
  WHEN {blocks("old")} <> {blocks("new")} THEN 'paragraphs' WHEN {edged("old", "garrick")} <> {edged("new", "garrick")} OR {edged("old", "of")} <> {edged("new", "of")} THEN 'names' END AS problem FROM u5),
edited AS MATERIALIZED (SELECT key, s, s + length(new) AS e, t[:s] || new || t[e + 1:] AS t FROM u6 WHERE problem IS NULL),
r0 AS ({before}), r1 AS ({after}),
fresh AS (SELECT DISTINCT d.key FROM edited d JOIN r1 ON r1.n = d.key AND r1.s < d.e AND d.s < r1.e JOIN u6 USING (key)
  WHERE NOT EXISTS (SELECT 1 FROM r0 WHERE r0.n = u6.n AND r0.rule_id = r1.rule_id AND r0.s < u6.e AND u6.s < r0.e)),
u7 AS (SELECT u6.*, coalesce(problem, CASE WHEN key IN (SELECT key FROM fresh) THEN 'new_problem' WHEN length(new) % 3 = 0 THEN 'fact lost: it' END) AS reason FROM u6)
SELECT n AS chapter_number, 'rewrite.passage' AS rule_id, s AS start, e AS "end", new AS said FROM u7 WHERE reason IS NULL
UNION ALL SELECT no.n, no.rule_id, no.s, no.e, '["' || reason || '"]' FROM no JOIN u7 ON u7.n = no.n AND u7.s <= no.s AND no.s < u7.e WHERE reason IS NOT NULL"""


def _repairs() -> str:
    new = " ".join(f"WHEN n % {len(REPAIRS)} = {i} THEN replace(old, {q(a)}, {q(b)})" for i, (a, b) in enumerate(REPAIRS))
    known = ", ".join(f"({q(w)}, {i})" for i, words in enumerate(repair.FAMILIES) for w in words)
    alike = lambda a, b: f"coalesce(nullif(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i]), false), 0) - 1, least(length({a}), length({b})))"
    return f"""WITH {RAW}, l0 AS (SELECT n, string_split(t, {NL}) AS ls FROM c), l1 AS (SELECT n, unnest(range(len(ls))) AS k, unnest(ls) AS old FROM l0),
l2 AS (SELECT *, CASE {new} END AS new FROM l1), l3 AS (SELECT *, reverse(old) AS ro, reverse(new) AS rn FROM l2),
l4 AS (SELECT *, {alike("old", "new")} AS p, {alike("ro", "rn")} AS z FROM l3),
l5 AS (SELECT *, least(z, least(length(old), length(new)) - p) AS sx FROM l4),
l6 AS (SELECT *, old[p + 1:length(old) - sx] AS removed, new[p + 1:length(new) - sx] AS added, old <> '' AND new <> '' AND old <> new AS changed FROM l5),
fam(w, f) AS (VALUES {known}),
wf AS (SELECT n, k, string_agg(DISTINCT f::VARCHAR, ',' ORDER BY f::VARCHAR) AS families FROM (SELECT n, k, unnest(regexp_extract_all(new, '[A-Za-z'']+')) AS x FROM l2) JOIN fam ON lower(x) = w GROUP BY n, k)
SELECT l6.n AS chapter_number, l6.k::INT AS k, removed, added,
  changed AND NOT (length(removed) > {repair.SWAP} AND length(added) > {repair.SWAP}) AND NOT (p + sx = 0 AND length(old) > {repair.LONE}) AS single,
  changed AND regexp_matches(removed, '\\S') AND NOT regexp_matches(added, '[A-Za-z'']') AS deletion, coalesce(families, '') AS families
FROM l6 LEFT JOIN wf USING (n, k)"""


SQL |= {
    "judge_candidates": f"""WITH {C}, {SKIP}, {PARAS}, lo AS ({_locations()}),
j0 AS (SELECT n, s, e, 'heuristic' AS source, 1 AS phase, 0 AS o FROM para y WHERE ((length({STRIPPED}) > 40 AND NOT regexp_matches({STRIPPED}, {q(findings.TERMINAL)})) OR regexp_matches(p, {AGREE})) AND {not_in("y")}
  UNION ALL SELECT chapter_number, start, "end", CASE WHEN rule_id LIKE 'word.%' THEN 'wordiness' ELSE 'echo' END, 3, CASE rule_id WHEN 'echo.local_repeat' THEN 7 WHEN 'echo.phrase_dup' THEN 8 ELSE 6 END
  FROM (SELECT chapter_number, start, "end", rule_id, chapter_number AS n, start AS s, "end" AS e FROM lo) y WHERE (rule_id LIKE 'word.%' OR rule_id LIKE 'echo.%') AND {not_in("y")}),
j1 AS (SELECT * FROM j0 QUALIFY row_number() OVER (PARTITION BY n, s, e ORDER BY phase, o) = 1),
j2 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY phase, o, s, e) AS nth FROM j1),
j3 AS (SELECT j2.*, regexp_replace(t[s + 1:e], '^\\s+|\\s+$', '', 'g') AS x FROM j2 JOIN c USING (n) WHERE nth <= 8)
SELECT {HEAD}, nth, source, CASE WHEN length(x) > 600 THEN regexp_replace(x[:599], '\\s+$', '') || '…' ELSE x END AS text FROM j3""",
    "rewrite_units": f"""WITH {C}, {m("bl", "[^\\n]+(?:\\n[^\\n]+)*")}, lo AS ({_locations()}),
no AS (SELECT chapter_number AS n, start AS s FROM lo WHERE rule_id LIKE 'echo.%' OR rule_id LIKE 'rhythm.%' OR rule_id LIKE 'weak.%'),
u0 AS (SELECT r.n, bl.k AS para, bl.s, bl.e, count(*) AS hits FROM no r JOIN bl ON bl.n = r.n AND bl.s <= r.s AND r.s < bl.e WHERE regexp_matches(bl.m, '[A-Za-z0-9'']') AND NOT starts_with(regexp_replace(bl.m, '^\\s+', ''), '#') GROUP BY r.n, bl.k, bl.s, bl.e),
u1 AS (SELECT *, para - row_number() OVER (PARTITION BY n ORDER BY para) AS isl FROM u0),
u2 AS (SELECT *, (row_number() OVER (PARTITION BY n, isl ORDER BY para) - 1) // 2 AS unit FROM u1),
u3 AS (SELECT n, min(para) AS first, max(para) AS last, min(s) AS s, max(e) AS e, sum(hits)::BIGINT AS hits FROM u2 GROUP BY n, isl, unit)
SELECT {HEAD}, first, last, hits FROM u3 QUALIFY row_number() OVER (PARTITION BY n ORDER BY hits DESC, s) <= 8""",
    "anchor_cursor": f"""WITH {RAW}, {m("ag", "[.!?]\\s+")},
a0 AS (SELECT n, s + 1 AS b, e AS nx FROM ag UNION ALL SELECT n, length(t), length(t) FROM c),
a1 AS (SELECT a0.n, coalesce(lag(nx) OVER (PARTITION BY a0.n ORDER BY nx, b), 0) AS a, b, t FROM a0 JOIN c USING (n)),
a2 AS (SELECT n, a, b, t[a + 1:b] AS x FROM a1 WHERE t[a + 1:b] <> '')
SELECT n AS chapter_number, (row_number() OVER (PARTITION BY n ORDER BY a))::INT AS n, x AS excerpt, a::INT AS start, b::INT AS "end" FROM a2""",
    "all_rules": f"SELECT * EXCLUDE (text, turn, note) FROM ({_all_rules()})",
    "check": _check(),
    "rewrites": _rewrites(),
    "dedupe": f"""WITH {FINDINGS}, df AS (SELECT *, '' AS message FROM fi), {deduped("df")} SELECT id, n AS chapter_number, r AS rule_id, s AS start, e AS "end" FROM kept""",
    "findings_said": f"""{_placed()}, sa0 AS (SELECT *, {_message()} AS message FROM placed), sa1 AS (SELECT *, {NUMBERED} FROM sa0)
SELECT {ID} AS id, n AS chapter_number, rule_id, message, coalesce(replacement, {_said(messages.SUGGESTIONS)}, '') AS suggestion FROM sa1""",
    "locations": _locations(),
    "line_numbers": f"WITH {C}, {SKIP}, {DOUBLE} SELECT d.n AS chapter_number, s AS start, len(string_split(t[:s], {NL}))::BIGINT AS line FROM double_space d JOIN c USING (n)",
    "report_summary": f"""WITH {FINDINGS}, fg AS (SELECT *, 'deterministic' AS engine FROM fi WHERE category NOT IN ('echo', 'rhythm', 'weakener', 'hollow')),
z(facet, value) AS (VALUES {", ".join(f"('severity', {q(x)})" for x in report.ZERO_SEVERITIES)}, {", ".join(f"('engine', {q(x)})" for x in findings.ENGINES)}, ('total', '')),
k AS (SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM fg GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM fg GROUP BY category
  UNION ALL SELECT 'engine', engine, count(*) FROM fg GROUP BY engine UNION ALL SELECT 'total', '', count(*) FROM fg)
SELECT facet, value, coalesce(n, 0) AS n FROM z FULL JOIN k USING (facet, value) UNION ALL SELECT 'applied_count', '', 0 UNION ALL SELECT 'chapters_scanned', '', count(*) FROM c""",
    "report_chapters": f"""WITH {FINDINGS}, ids AS (SELECT n, string_agg(id, ',' ORDER BY seq) AS finding_ids FROM fi WHERE category NOT IN ('echo', 'rhythm', 'weakener', 'hollow') GROUP BY n)
SELECT s.chapter_number, 'chapter-' || s.chapter_number AS chapter_path, s.title, coalesce(finding_ids, '') AS finding_ids FROM ({SQL["chapter_scan"]}) s LEFT JOIN ids ON ids.n = s.chapter_number""",
    "name_tokens": """WITH c AS (SELECT replace(c_name, '#', ' ') AS name, regexp_extract_all(replace(c_name, '#', ' '), '[^ ]+') AS p FROM customer),
f AS (SELECT name, p, count(*) OVER (PARTITION BY lower(p[1])) AS same_first, count(CASE WHEN len(p) > 1 THEN 1 END) OVER (PARTITION BY lower(CASE WHEN len(p) > 1 THEN p[-1] END)) AS same_last FROM c)
SELECT name, array_to_string([x FOR x IN [name, CASE WHEN same_first = 1 AND length(p[1]) >= 2 THEN p[1] END, CASE WHEN len(p) > 1 AND same_last = 1 AND length(p[-1]) >= 4 THEN p[-1] END] IF x IS NOT NULL], '|') AS tokens, 4::BIGINT AS family FROM f""",
    "repair_gates": _repairs(),
}
