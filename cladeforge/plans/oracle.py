"""SQL twins of the fixtures and of the operators, as common table expressions.

with_() puts a query behind those it needs.
"""

from __future__ import annotations

import re

from ..functions.alphabet import Scheme

S = Scheme()


def seg(seed: str) -> str:
    return f"translate(md5({seed}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def code(word: str) -> str:
    bits = f"replace(replace(replace(replace({word}, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11')"
    return f"CAST(CAST(repeat('0', 64 - length({bits})) || {bits} AS BIT) AS BIGINT)"


def rank(word: str, s: Scheme = S) -> str:
    return f"(xor({code(f'least({word}, {revcomp(word)})')}, {s.xor_mask}) & {s.space_mask})"


def kmers(name: str, source: str, s: Scheme = S) -> dict[str, str]:
    """name: header, pos, mn for each k-mer of source (header, nt); name_spans: header, g, location, kmers, mn."""
    w = s.k - s.m
    return {
        f"{name}_w": f"SELECT header, pos, substr(nt, pos, {s.m}) AS w FROM (SELECT header, nt, unnest(range(1, length(nt) - {s.m} + 2)) AS pos FROM {source})",
        f"{name}_p": f"SELECT header, pos, CASE WHEN NOT contains(w, 'N') THEN {rank('w', s)} END AS p FROM {name}_w",
        name: f"SELECT header, pos, mn FROM (SELECT header, pos, min(p) OVER q AS mn, count(p) OVER q AS c FROM {name}_p WINDOW q AS (PARTITION BY header ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING)) WHERE c = {w + 1}",
        f"{name}_g": f"SELECT header, pos, mn, sum(f) OVER (PARTITION BY header ORDER BY pos) AS g FROM (SELECT header, pos, mn, CASE WHEN lag(mn) OVER o = mn AND lag(pos) OVER o = pos - 1 THEN 0 ELSE 1 END AS f FROM {name} WINDOW o AS (PARTITION BY header ORDER BY pos))",
        f"{name}_spans": f"SELECT header, g, min(pos) - 1 AS location, count(*) AS kmers, min(mn) AS mn FROM {name}_g GROUP BY header, g",
    }


CTES: dict[str, str] = {
    "parts": """SELECT p_partkey, p_name AS name, 10 + brand % 5 AS fam, 100 + brand AS gen, 1000 + brand * 10 + typ AS spe, CAST(10000 + p_partkey AS INTEGER) AS tax
        FROM (SELECT p_partkey, p_name, CAST(substr(p_brand, 7) AS INTEGER) AS brand, CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS typ FROM part)""",
    "nodes": """SELECT 1 AS taxon, 0 AS parent, 0 AS rank, 'root' AS name
        UNION ALL SELECT DISTINCT fam, 1, 6, 'family ' || fam FROM parts UNION ALL SELECT DISTINCT gen, fam, 7, 'genus ' || gen FROM parts
        UNION ALL SELECT DISTINCT spe, gen, 8, 'species ' || spe FROM parts UNION ALL SELECT tax, spe, NULL, name FROM parts""",
    # every node with its ancestors, itself included; level: steps from the root; depth: of the nearest rank
    "tree": """SELECT taxon, parent, rank, name, 0 AS level, coalesce(rank, 0) AS depth FROM nodes WHERE taxon = 1
        UNION ALL SELECT n.taxon, n.parent, n.rank, n.name, t.level + 1, coalesce(n.rank, t.depth) FROM nodes n JOIN tree t ON n.parent = t.taxon""",
    "anc": """SELECT taxon, taxon AS a, 0 AS steps FROM nodes
        UNION ALL SELECT c.taxon, n.parent, c.steps + 1 FROM anc c JOIN nodes n ON n.taxon = c.a WHERE n.parent > 0""",
    "genomes": f"""SELECT 'G' || p_partkey AS header, {' || '.join(seg(f"'{c[0]}:' || {c} || ':{i}'") for c, n in (("gen", 3), ("spe", 3), ("tax", 4)) for i in range(n))} AS nt, tax AS taxon FROM parts""",
    "cut_reads": """SELECT o, truth, g, off, substr(g, off, 100) AS r FROM (
        SELECT o_orderkey AS o, taxon AS truth, nt AS g, CAST((o_orderkey * 37) % 221 + 1 AS INTEGER) AS off
        FROM orders JOIN genomes ON taxon - 10000 = o_orderkey % (SELECT count(*) FROM part))""",
    "reads": f"""SELECT 'S' || (o % 4) || 'R' || o AS header, CASE WHEN o % 20 = 0 THEN repeat('N', 36) || substr(r, 37) ELSE r END AS nt, mate AS nt2, truth FROM (
        SELECT o, truth, CASE WHEN o % 10 = 0 THEN substr(r, 1, 49) || 'N' || substr(r, 51) ELSE r END AS r, mate FROM (
        SELECT o, truth, CASE WHEN o % 3 = 1 THEN {revcomp('r')} ELSE r END AS r, {revcomp('substr(g, 222 - off, 100)')} AS mate FROM cut_reads))""",
    **kmers("gk", "genomes"),
    # minimizers of genomes with the taxa on their way
    "gmin": "SELECT s.mn, s.kmers, p.tax, p.spe, p.gen, p.fam FROM gk_spans s JOIN genomes g USING (header) JOIN parts p ON p.tax = g.taxon",
    "idx": """SELECT mn AS id1, CAST(CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen)
        WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS INTEGER) AS taxon FROM gmin GROUP BY mn""",
    **kmers("rk", "reads"),
    "rspans": f"""SELECT header AS title, location, 1 AS flag, CAST(kmers AS INTEGER) AS kmers, mn FROM rk_spans
        UNION ALL SELECT header, 0, 2, CAST(length(regexp_extract(nt, '^N+')) - {S.k - 1} AS INTEGER), NULL FROM reads WHERE length(regexp_extract(nt, '^N+')) >= {S.k}""",
    "spans": """SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY location) - 1 AS INTEGER) AS ordinal, flag,
        flag = 1 AND coalesce(lag(mn) OVER (PARTITION BY title, flag ORDER BY location) <> mn, true) AS is_distinct, kmers, mn AS minimizer FROM rspans""",
    "hits": """SELECT title, ordinal, is_distinct, CAST(CASE WHEN flag = 2 THEN -1 ELSE coalesce(i.taxon, 0) END AS INTEGER) AS taxon, kmers AS count, minimizer
        FROM spans s LEFT JOIN idx i ON s.minimizer = i.id1""",
    "per_read": "SELECT title, sum(count) AS total, count(*) FILTER (is_distinct AND taxon <> 0) AS n_distinct FROM hits GROUP BY title",
    "per_taxon": "SELECT title, taxon, sum(count) AS n FROM hits WHERE taxon > 0 GROUP BY title, taxon",
    "scores": "SELECT t.title, t.taxon, sum(o.n) AS score FROM per_taxon t JOIN anc ON anc.taxon = t.taxon JOIN per_taxon o ON o.title = t.title AND o.taxon = anc.a GROUP BY t.title, t.taxon",
    "tops": "SELECT title, taxon, count(*) OVER (PARTITION BY title) AS n FROM (SELECT *, max(score) OVER (PARTITION BY title) AS best FROM scores) WHERE score = best",
    "lcas": "SELECT title, arg_max(a, level) AS taxon FROM (SELECT t.title, c.a, tr.level FROM tops t JOIN anc c ON c.taxon = t.taxon JOIN tree tr ON tr.taxon = c.a GROUP BY t.title, c.a, tr.level, t.n HAVING count(*) = t.n) GROUP BY title",
    "lifts": "SELECT b.title, c.steps, c.a, sum(o.n) AS clade FROM lcas b JOIN anc c ON c.taxon = b.taxon JOIN per_taxon o ON o.title = b.title JOIN anc d ON d.taxon = o.taxon AND d.a = c.a GROUP BY b.title, c.steps, c.a",
    # order counts over the nations
    "nnodes": """SELECT 1 AS taxon, 0 AS parent, 0 AS depth, 'root' AS name UNION ALL SELECT CAST(r_regionkey + 10 AS INTEGER), 1, 1, r_name FROM region
        UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), CAST(n_regionkey + 10 AS INTEGER), 7, n_name FROM nation
        UNION ALL SELECT CAST(c_custkey + 1000 AS INTEGER), CAST(c_nationkey + 100 AS INTEGER), 8, c_name FROM customer""",
    "nanc": "SELECT taxon, taxon AS a, 0 AS steps FROM nnodes UNION ALL SELECT c.taxon, n.parent, c.steps + 1 FROM nanc c JOIN nnodes n ON n.taxon = c.a WHERE n.parent > 0",
    "ncounts": "SELECT CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_custkey + 1000 END AS INTEGER) AS taxon, count(*) AS n FROM orders GROUP BY 1",
    "nclade": """SELECT a AS taxon, CAST(sum(n) AS BIGINT) AS clade, CAST(sum(CASE WHEN c.taxon = a THEN n ELSE 0 END) AS BIGINT) AS own FROM ncounts c JOIN nanc USING (taxon) GROUP BY a
        UNION ALL SELECT taxon, n, n FROM ncounts WHERE taxon = 0""",
    "assigned": """SELECT id, tax AS ref_taxon, CAST(CASE s % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN fam WHEN 3 THEN gen WHEN 4 THEN spe WHEN 5 THEN tax ELSE 10000 + s END AS INTEGER) AS test_taxon
        FROM (SELECT l_orderkey * 10 + l_linenumber AS id, arg_min(l_partkey, (l_partkey, l_suppkey)) AS k, arg_min(l_suppkey, (l_partkey, l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber)
        JOIN parts ON p_partkey = k""",
    # the reference's ancestor at species and what the test is to it
    "cats": """SELECT id, ref_taxon, test_taxon, CASE WHEN test_taxon = 0 THEN 'FalseNeg' WHEN ref_taxon = test_taxon OR below THEN 'TruePos' WHEN above OR test_taxon = 1 THEN 'VaguePos' ELSE 'FalsePos' END AS category,
        CASE WHEN test_taxon = 0 THEN 9 WHEN ref_taxon = test_taxon OR below THEN 0 WHEN above THEN rd - td ELSE 9 END AS idx FROM (
        SELECT x.*, EXISTS (SELECT 1 FROM anc WHERE anc.taxon = x.test_taxon AND anc.a = p.spe) AS below, EXISTS (SELECT 1 FROM anc WHERE anc.taxon = x.ref_taxon AND anc.a = x.test_taxon) AS above, r.depth AS rd, t.depth AS td
        FROM assigned x JOIN parts p ON p.tax = x.ref_taxon JOIN tree r ON r.taxon = x.ref_taxon LEFT JOIN tree t ON t.taxon = x.test_taxon)""",
}


def resolved(confidence: float, name: str = "cls", groups: int = 2) -> dict[str, str]:
    """name: title, taxon (0: none) of all reads at a confidence."""
    ok = f"l.clade >= ceil({confidence} * r.total)"
    return {
        name: f"""SELECT r.title, CAST(CASE WHEN r.n_distinct >= {groups} THEN coalesce(x.taxon, 0) ELSE 0 END AS INTEGER) AS taxon FROM per_read r LEFT JOIN (
        SELECT l.title, arg_min(l.a, l.steps) AS taxon FROM lifts l JOIN per_read r USING (title) WHERE {ok} GROUP BY l.title) x USING (title)"""
    }


def renamed(names: tuple[str, ...], more: dict[str, str], mark: str, **others: str) -> dict[str, str]:
    """Copies of expressions under names with a mark, that refer to each other, and to others as told."""
    texts = {n: CTES[n] for n in names} | more
    change = {n: n + mark for n in texts} | others
    pattern = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(sorted(change, key=len, reverse=True)) + r")\b")
    return {n + mark: pattern.sub(lambda m: f"{m[1]} {change[m[2]]}", t) for n, t in texts.items()}


def with_(query: str, extra: dict[str, str] | None = None) -> str:
    """The query behind the expressions it needs, each once, in order of need."""
    known = CTES | (extra or {})
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in order and re.search(rf"\b{name}\b(?!\s*\()", text) and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                need(known[name], name)
                if name not in order:
                    order.append(name)

    need(query)
    if not order:
        return query
    # used more than once, and dear: computed once
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('tree', 'anc', 'nanc') else 'MATERIALIZED '}({known[n]})" for n in order) + "\n" + query
