"""SQL that a second engine runs for comparison with the queries."""

from __future__ import annotations

from .merkle import FANOUT
from .mixing import LEAST_GAIN, MOST_SWEEPS, NONE, PLACES, STRIDE, SWEEPS, TOLERANCE
from .queries import INJECTED, MIX, URL_RULES
from .sketch import MULTIPLIERS, PRIME, SCALE
from .url_filter import DAMPING, STRIDE as ROUNDS, THRESHOLD, TOLERANCE as SETTLED


def _url_filter() -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(str(r)), -len(r.host)))
    fits = [
        f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in ordered
    ]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ordered, strict=True))
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
located AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {letters}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS MATERIALIZED (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM located),
hosts AS MATERIALIZED (
  SELECT host, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked,
         count(*) AS pages
  FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, regexp_replace(found, '(?i)^href\\s*=\\s*["'']?|["'']$', '', 'g') AS link FROM (
    SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+)', 0)) AS found
    FROM located WHERE host <> '')),
targets AS (
  SELECT src, CASE WHEN starts_with(link, '//') THEN translate(regexp_extract(link, '^//([^/?#]*)', 1), {letters})
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://')
      THEN translate(regexp_extract(link, '://([^/?#]*)', 1), {letters})
    ELSE src END AS dst
  FROM links WHERE NOT regexp_matches(lower(link), '^\\s*(#|javascript:|mailto:|data:|tel:)')),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM targets WHERE dst <> '' GROUP BY src, dst),
ways AS (
  SELECT 'trust' AS kind, src AS origin, dst AS target, links FROM edges
  UNION ALL SELECT 'distrust', dst, src, links FROM edges),
nodes AS (SELECT host FROM hosts UNION SELECT src FROM edges UNION SELECT dst FROM edges),
seeds AS MATERIALIZED (
  SELECT 'trust' AS kind, n.host, coalesce(coalesce(h.allowed, 0) / nullif((SELECT sum(allowed) FROM hosts), 0), 0) AS seed
  FROM nodes n LEFT JOIN hosts h ON h.host = n.host
  UNION ALL
  SELECT 'distrust', n.host, coalesce(coalesce(h.blocked, 0) / nullif((SELECT sum(blocked) FROM hosts), 0), 0)
  FROM nodes n LEFT JOIN hosts h ON h.host = n.host),
graph AS MATERIALIZED (
  SELECT kind, origin, target, links / sum(links) OVER (PARTITION BY kind, origin) AS part FROM ways
  UNION ALL
  SELECT s.kind, s.host, s.host, 1.0 FROM seeds s
  WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.kind = s.kind AND w.origin = s.host)),
rounds AS (
  SELECT kind, host, seed, seed AS rank, 0 AS done, false AS stop FROM seeds
  UNION ALL
  SELECT kind, host, seed, rank, done, done % {ROUNDS} = 0 AND max(change) OVER () <= {SETTLED} AS stop FROM (
    SELECT *, sum(abs(rank - before)) OVER (PARTITION BY kind) AS change FROM (
      SELECT r.kind, r.host, r.seed, r.rank AS before, r.done + 1 AS done,
        {1 - DAMPING} * r.seed + {DAMPING} * coalesce(i.inflow, 0) AS rank
      FROM rounds r LEFT JOIN (
        SELECT g.kind, g.target, sum(x.rank * g.part) AS inflow
        FROM graph g JOIN rounds x ON x.kind = g.kind AND x.host = g.origin GROUP BY g.kind, g.target) i
        ON i.kind = r.kind AND i.target = r.host
      WHERE NOT r.stop))),
ranks AS (
  SELECT host, sum(rank) FILTER (kind = 'distrust') - sum(rank) FILTER (kind = 'trust') AS excess
  FROM rounds WHERE stop GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.by_rule, CASE WHEN r.excess > {THRESHOLD} * h.pages / (SELECT sum(pages) FROM hosts) THEN 'block' END, 'allow')
    AS verdict,
  j.by_rule IS NULL AS by_host
FROM judged j LEFT JOIN hosts h ON h.host = j.host LEFT JOIN ranks r ON r.host = j.host"""


def _chat_format() -> str:
    # The length of a turn: its two control strings, two line breaks, role and text,
    # and a character more for each control string in them.
    marks = len("<|im_start|>") + len("<|im_end|>") + 2
    more = r"len(regexp_extract_all({0}, '<\\*\|'))"
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{INJECTED}'), (-1, 1, 'assistant', '{INJECTED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + length(role) + length(text) + {more.format("role")} + {more.format("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


_VECTOR_SEARCH = """WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM points q JOIN points c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""


_NGRAM_JOIN = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS overlap
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * overlap >= 90 * (total - overlap)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id,
  (SELECT count(*) FROM links l WHERE l.a = s.doc_id)::BIGINT AS n_links
FROM sets s JOIN smallest m ON m.a = s.doc_id"""


def _mixing() -> str:
    """Each step of the recursion is a stride of sweeps; the last one's best cells are the fit."""
    weights = " ".join(f"WHEN '{lang}' THEN {weight}" for lang, weight in MIX.weights["lang"].items())
    raw = {
        "source": f"pow(of_source, {MIX.flatten['source']})",
        "lang": f"CASE lang {weights} END",
        "topic": f"pow(of_topic, {MIX.flatten['topic']})",
    }
    scaled = []
    for d in raw:
        named = f"sum(CASE WHEN of_{d} > 0 THEN raw_{d} * tokens / of_{d} END) OVER ()"
        rest = f"coalesce(sum(tokens) FILTER (raw_{d} IS NULL AND of_{d} > 0) OVER (), 0)"
        scaled.append(f"coalesce(raw_{d} * coalesce({MIX.rate} * (total - {rest}) / nullif({named}, 0), 0), {MIX.rate} * of_{d}) AS w_{d}")
    swept = "raked"
    for _ in range(STRIDE):
        for d in raw:
            swept = f"""(SELECT * REPLACE (CASE WHEN drawn > 0 THEN least(1.0, p * w_{d} / drawn) ELSE p END AS p) FROM (
    SELECT * EXCLUDE (drawn), sum(p * tokens) OVER (PARTITION BY {d}) AS drawn FROM {swept}))"""
    gaps = ", ".join(
        f"CASE WHEN of_{d} > 0 THEN abs(sum(p * tokens) OVER (PARTITION BY {d}) - w_{d}) / ({MIX.rate} * total) END" for d in raw
    )
    return f"""WITH RECURSIVE placed AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS m_source, coalesce(lang, '{NONE}') AS m_lang,
    CASE WHEN contains(text, 'Licensed under') THEN 'licensed' WHEN contains(text, ' | ') THEN 'table'
      WHEN regexp_matches(text, '[!#$%&*][!#$%&*]') THEN 'marked' ELSE 'prose' END AS m_topic,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n
  FROM documents),
cells AS (
  SELECT m_source AS source, m_lang AS lang, m_topic AS topic, sum(n)::DOUBLE AS tokens FROM placed GROUP BY ALL),
totals AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source) AS of_source, sum(tokens) OVER (PARTITION BY lang) AS of_lang,
    sum(tokens) OVER (PARTITION BY topic) AS of_topic, sum(tokens) OVER () AS total FROM cells),
weighted AS (SELECT *, {", ".join(f"{e} AS raw_{d}" for d, e in raw.items())} FROM totals),
start AS MATERIALIZED (
  SELECT source, lang, topic, tokens, total, of_source, of_lang, of_topic, {", ".join(scaled)} FROM weighted),
raked AS (
  SELECT *, {MIX.rate}::DOUBLE AS p, {MIX.rate}::DOUBLE AS best, 0 AS done, NULL::DOUBLE AS gap, total = 0 AS stop, 0::DOUBLE AS drawn
  FROM start
  UNION ALL
  SELECT * EXCLUDE (cell_gap, new_gap) REPLACE (
    CASE WHEN done < {SWEEPS} OR gap - new_gap < {LEAST_GAIN} THEN best ELSE p END AS best,
    CASE WHEN done < {SWEEPS} OR gap - new_gap < {LEAST_GAIN} THEN gap ELSE new_gap END AS gap,
    CASE WHEN done < {SWEEPS} THEN false ELSE coalesce(gap - new_gap < {LEAST_GAIN}, false) OR new_gap <= {TOLERANCE} OR done >= {MOST_SWEEPS} END AS stop)
  FROM (
    SELECT *, max(cell_gap) OVER () AS new_gap FROM (
      SELECT * REPLACE (done + {STRIDE} AS done), greatest(0.0, {gaps}) AS cell_gap FROM {swept} AS swept WHERE NOT stop)
    ) AS judged (source, lang, topic, tokens, total, of_source, of_lang, of_topic, w_source, w_lang, w_topic,
                 p, best, done, gap, stop, drawn, cell_gap, new_gap)),
fitted AS (
  SELECT source, lang, topic, CASE WHEN best > 0 THEN greatest(round(best, {PLACES}), 1e-{PLACES}) ELSE 0 END AS p FROM raked WHERE stop)
SELECT d.doc_id, d.source, d.lang, d.m_topic AS mix_topic, d.n AS mix_tokens, f.p AS mix_probability,
  round(1 / f.p, 6) AS mix_weight
FROM placed d JOIN fitted f ON f.source = d.m_source AND f.lang = d.m_lang AND f.topic = d.m_topic
WHERE ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 < f.p"""


_HARD_NEGATIVES = """WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT q.r AS anchor, q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM points q JOIN points c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 3"""


def _merkle_manifest(height: int = 8) -> str:
    """Trees of up to ``height`` levels; a tree that has ended goes up unchanged."""

    def text(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(body: str) -> str:
        fields = [*(f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")), body]
        return f"sha256({' || '.join(text(f) for f in fields)})"

    steps = []
    for name in ("s", "u"):
        for k in range(height):
            run = f"PARTITION BY tree, pos // {FANOUT} ORDER BY pos"
            steps.append(
                f"""{name}{k}_sibs AS MATERIALIZED (
  SELECT *, coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})"""
            )
            steps.append(
                f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos // {FANOUT} AS pos, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n,
    CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM {name}{k} GROUP BY tree, pos // {FANOUT})"""
            )
        if name == "s":
            steps.append(f"u0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, node FROM s{height})")
    # From the leaf upwards: one level's siblings are put around the node at a time.
    last = "leaves"
    for name in ("s", "u"):
        for k in range(height):
            at = f"d.pos // {FANOUT**k}" if name == "s" else f"d.tree // {FANOUT**k}"
            tree = "d.tree" if name == "s" else "0"
            steps.append(
                f"""{name}{k}_way AS (
  SELECT d.* REPLACE (d.proof || x.b || x.a AS proof,
    CASE WHEN x.n > 1 THEN sha256(x.b || d.folded || x.a) ELSE d.folded END AS folded)
  FROM {last} d JOIN {name}{k}_sibs x ON x.tree = {tree} AND x.pos = {at})"""
            )
            last = f"{name}{k}_way"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    step = "lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"""xor(4294967295, list_reduce(
      [4294967295::UBIGINT] || [ascii(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')],
      lambda v, x: list_reduce([xor(v, x)] || [0::UBIGINT for i in range(8)], {step})))"""
    return f"""WITH hashed AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f"translate(text, {letters})")} END AS presented
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, leaf, coalesce(presented, leaf) AS folded, '' AS proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
s0 AS (SELECT tree, pos, n, leaf AS node FROM leaves),
{",".join(steps)}
SELECT d.doc_id, d.leaf, t.node AS subroot, r.node AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
  d.folded = r.node AS verified
FROM {last} d JOIN s{height} t ON t.tree = d.tree CROSS JOIN u{height} r"""


def _fingerprints() -> str:
    def kept(words: str) -> str:
        runs = " + ".join(f"{m}::HUGEINT * coalesce({words}[i + {k}], 0)" for k, m in enumerate(MULTIPLIERS))
        return f"list_sort(list_distinct([({runs}) % {PRIME} for i in range(1, greatest(len({words}) - {len(MULTIPLIERS) - 1}, least(len({words}), 1)) + 1)]))"

    def values(text: str) -> str:
        lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        found = rf"regexp_extract_all({lowered}, '[^ \t\n\x0B\f\r]+')"
        return f"[('0x' || substr(md5(w), 1, 8))::UBIGINT::HUGEINT for w in {found}]"

    def low(hashes: str) -> str:
        return f"CASE WHEN len([h for h in {hashes} if h < {PRIME // SCALE}]) = 0 THEN {hashes}[:1] ELSE [h for h in {hashes} if h < {PRIME // SCALE}] END"

    def digits(sketch: str) -> str:
        return f"list_reduce([''] || [lower(printf('%016x', h::BIGINT)) for h in {sketch}], lambda x, y: x || y)"

    def share(other: str) -> str:
        return f"CASE WHEN len(own) = 0 THEN (len({other}) = 0)::INT::DOUBLE ELSE len(list_intersect(own, {other})) / len(own)::DOUBLE END"

    return rf"""WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
following AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next
  FROM texts),
cut AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next, 1, n_chars // 2) AS edited FROM following),
words AS (SELECT *, {values("text")} AS w, {values("edited")} AS e, {values("next")} AS x FROM cut),
hashed AS (SELECT doc_id, n_chars, edited, {kept("w")} AS w, {kept("e")} AS e, {kept("x")} AS x FROM words),
sketched AS (SELECT doc_id, n_chars, edited, {low("w")} AS own, {low("e")} AS other, {low("x")} AS next FROM hashed)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {digits("own")} AS fingerprint, {digits("other")} AS edited_fingerprint,
  {share("other")} AS near_edited, {share("next")} AS near_next
FROM sketched"""


ORACLE: dict[str, str] = {
    "op1_ngram_join": _NGRAM_JOIN.replace("\\\\", "\\"),
    "op2_url_filter": _url_filter(),
    "op5_chat_format": _chat_format(),
    "op6_mixing": _mixing(),
    "op10_vector_search": _VECTOR_SEARCH,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_merkle_manifest": _merkle_manifest(),
    "op13_fingerprints": _fingerprints().replace("\\\\", "\\"),
}
