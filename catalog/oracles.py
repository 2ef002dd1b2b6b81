"""SQL for DuckDB that gives the result of each query from the same tables."""

from __future__ import annotations

DIM = 64  # length of the given vectors
LABELINGS = (("label", 10), ("mod5", 5), ("mod20", 20))

# Named inputs, each with the inputs it reads; see FIXTURES.md.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens": (
        (),
        r"SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word"
        " FROM documents",
    ),
    "lexicon": (
        ("tokens",),
        "SELECT word, count(*)::DOUBLE AS frequency FROM tokens GROUP BY word",
    ),
    "by_lang": (
        ("tokens",),
        "SELECT word, lang, count(*)::DOUBLE AS frequency FROM tokens GROUP BY word, lang",
    ),
    "dirty": (
        ("by_lang",),
        """SELECT CASE WHEN word = 'la' THEN NULL WHEN lang = 'fr' THEN ' ' || word
             WHEN lang = 'de' THEN word || chr(160) WHEN lang = 'es' THEN word || chr(9)
             ELSE word END AS word, frequency FROM by_lang""",
    ),
    "vocab": (
        (),
        r"""SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (
             SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word
             FROM conversations)""",
    ),
    "weights": (
        ("vocab",),
        """SELECT idx, list_transform(embedding, lambda x: x * (1 + idx % 3)) AS features
           FROM vocab JOIN embeddings ON vec_id = idx % (SELECT count(*) FROM embeddings)""",
    ),
    "points": (
        (),
        "SELECT vec_id AS word_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, label"
        " FROM embeddings",
    ),
    "asg": (
        ("points",),
        " UNION ALL ".join(
            f"SELECT '{name}' AS algorithm, {k} AS k, word_id, "
            f"({'label' if name == 'label' else f'word_id % {k}'})::INT AS cluster, x FROM points"
            for name, k in LABELINGS
        ),
    ),
    "cents": (
        ("asg",),
        "SELECT algorithm, k, cluster, count(*) AS n, ["
        + ", ".join(f"sum(x[{i}])" for i in range(1, DIM + 1))
        + "] AS s, sum(list_inner_product(x, x)) AS q FROM asg GROUP BY ALL",
    ),
    "centroids": (
        ("cents",),
        "SELECT algorithm, k, cluster, n, s, q, list_transform(s, lambda v: v / n) AS c FROM cents",
    ),
    "within": (
        ("asg", "centroids"),
        """SELECT a.algorithm, a.k, a.cluster, avg(list_distance(a.x, c.c)) AS spread,
             sum(list_distance(a.x, c.c) ** 2) AS w
           FROM asg a JOIN centroids c USING (algorithm, k, cluster) GROUP BY ALL""",
    ),
    "wcss_t": (("within",), "SELECT algorithm, k, sum(w) AS wcss FROM within GROUP BY ALL"),
    "db_t": (
        ("centroids", "within"),
        """SELECT algorithm, k, avg(worst) AS davies_bouldin FROM (
             SELECT a.algorithm, a.k, a.cluster,
               max((wa.spread + wb.spread) / list_distance(a.c, b.c)) AS worst
             FROM centroids a JOIN centroids b USING (algorithm, k)
             JOIN within wa ON (wa.algorithm, wa.k, wa.cluster) = (a.algorithm, a.k, a.cluster)
             JOIN within wb ON (wb.algorithm, wb.k, wb.cluster) = (b.algorithm, b.k, b.cluster)
             WHERE a.cluster <> b.cluster GROUP BY ALL) GROUP BY ALL""",
    ),
    "ch_t": (
        ("asg", "centroids", "wcss_t"),
        "SELECT algorithm, k, (b / (kk - 1)) / (wcss / (nn - kk)) AS calinski_harabasz FROM ("
        " SELECT c.algorithm, c.k, sum(n * list_distance(c.c, g.g) ** 2) AS b,"
        " count(*) AS kk, sum(n) AS nn FROM centroids c JOIN ("
        "   SELECT algorithm, k, ["
        + ", ".join(f"avg(x[{i}])" for i in range(1, DIM + 1))
        + "] AS g FROM asg GROUP BY ALL) g USING (algorithm, k) GROUP BY ALL"
        ") JOIN wcss_t USING (algorithm, k)",
    ),
    "dist": (
        ("points",),
        """SELECT a.word_id AS src, b.word_id AS dst, list_distance(a.x, b.x) AS d
           FROM points a JOIN points b ON a.word_id <> b.word_id""",
    ),
    "sampled": (
        ("points",),
        """SELECT word_id FROM points
           ORDER BY ('0x' || substr(md5('42:' || word_id), 1, 15))::BIGINT, word_id LIMIT 300""",
    ),
    "knn": (
        ("dist",),
        """SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank, d
           FROM dist QUALIFY rank <= 10""",
    ),
    "pairs": (
        (),
        r"""SELECT DISTINCT least(t[i], t[i + 1]) AS w1, greatest(t[i], t[i + 1]) AS w2 FROM (
             SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM (
               SELECT regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents))""",
    ),
    "synsets": (
        ("by_lang",),
        "SELECT word, word || '@' || lang AS synset_id FROM by_lang",
    ),
    "names": (
        ("by_lang",),
        """SELECT lang, word || '@' || lang AS sid, 'p3:' || left(word, 3) || '@' || lang AS p3,
             'p1:' || left(word, 1) || '@' || lang AS p1,
             's2:' || right(word, 2) || '@' || lang AS s2,
             's1:' || right(word, 1) || '@' || lang AS s1 FROM by_lang""",
    ),
    "hypernyms": (
        ("names",),
        """SELECT sid AS synset_id, p3 AS hypernym_id FROM names UNION SELECT p3, p1 FROM names
           UNION SELECT p1, 'lang:' || lang FROM names UNION SELECT sid, s2 FROM names
           UNION SELECT s2, s1 FROM names""",
    ),
    "sense_pairs": (
        ("pairs", "synsets"),
        """SELECT w1, w2, a.synset_id AS s1, b.synset_id AS s2 FROM pairs
           JOIN synsets a ON a.word = w1 JOIN synsets b ON b.word = w2""",
    ),
    "up": (
        ("synsets", "hypernyms"),
        """SELECT synset_id, ancestor, min(u) AS u FROM (
             WITH RECURSIVE r AS (
               SELECT DISTINCT synset_id, synset_id AS ancestor, 0 AS u FROM synsets
               UNION ALL
               SELECT r.synset_id, h.hypernym_id, u + 1 FROM r
               JOIN hypernyms h ON h.synset_id = r.ancestor)
             SELECT * FROM r) GROUP BY ALL""",
    ),
    "clusters": (
        ("lexicon",),
        """SELECT 'hashed' AS algorithm,
             ('0x' || substr(md5('cluster:' || word), 1, 15))::BIGINT % 2000 AS cluster, word
             FROM lexicon
           UNION ALL
           SELECT 'shape', ('0x' || substr(md5('shape:' || left(word, 2) || right(word, 1)
             || length(word)), 1, 15))::BIGINT, word FROM lexicon
           UNION ALL
           SELECT 'single', ('0x' || substr(md5('single:' || word), 1, 15))::BIGINT, word
             FROM lexicon""",
    ),
    "members": (
        ("clusters", "synsets"),
        """SELECT algorithm, cluster, word, synset_id FROM clusters JOIN synsets USING (word)
           WHERE algorithm <> 'single'""",
    ),
    "member_pairs": (
        ("members",),
        """SELECT a.algorithm, a.cluster, a.word AS w1, b.word AS w2,
             a.synset_id AS s1, b.synset_id AS s2
           FROM members a JOIN members b ON b.algorithm = a.algorithm
             AND b.cluster = a.cluster AND a.word < b.word""",
    ),
    "path_pairs": (
        ("member_pairs", "up"),
        """SELECT algorithm, cluster, w1, w2, max(sim) AS sim FROM member_pairs JOIN (
             SELECT s1, s2, 1.0::DOUBLE / (1 + min(a.u + b.u)) AS sim
             FROM (SELECT DISTINCT s1, s2 FROM member_pairs)
             JOIN up a ON a.synset_id = s1
             JOIN up b ON b.synset_id = s2 AND b.ancestor = a.ancestor
             GROUP BY ALL) USING (s1, s2) GROUP BY ALL""",
    ),
    "jaccard_pairs": (
        ("members", "hypernyms"),
        """SELECT algorithm, cluster, w1, w2,
             max(n_both::DOUBLE / (na.n + nb.n - n_both)) AS sim FROM (
             SELECT a.algorithm, a.cluster, a.word AS w1, b.word AS w2,
               a.synset_id AS s1, b.synset_id AS s2, count(*) AS n_both
             FROM members a JOIN hypernyms ha ON ha.synset_id = a.synset_id
             JOIN hypernyms hb ON hb.hypernym_id = ha.hypernym_id
             JOIN members b ON b.synset_id = hb.synset_id AND b.algorithm = a.algorithm
               AND b.cluster = a.cluster AND a.word < b.word
             GROUP BY ALL) p
           JOIN (SELECT synset_id, count(*) AS n FROM hypernyms GROUP BY 1) na
             ON na.synset_id = s1
           JOIN (SELECT synset_id, count(*) AS n FROM hypernyms GROUP BY 1) nb
             ON nb.synset_id = s2
           GROUP BY ALL""",
    ),
    "sizes": (
        ("clusters",),
        "SELECT algorithm, cluster, count(*) AS n_words FROM clusters GROUP BY ALL",
    ),
    "metrics": (
        (),
        """SELECT l_linestatus AS model, (50 * (1 + l_linenumber % 6))::INT AS k,
             l_returnflag AS "Algorithm", avg(l_extendedprice) AS "WCSS",
             avg(l_discount) AS "Silhouette", avg(l_tax) AS "Davies_Bouldin",
             avg(l_quantity) AS "Calinski_Harabasz"
           FROM lineitem GROUP BY ALL""",
    ),
    "long": (
        ("metrics",),
        """SELECT model, k, "Algorithm", metric, value,
             metric IN ('Silhouette', 'Calinski_Harabasz') AS higher_is_better FROM (
             UNPIVOT metrics ON "WCSS", "Silhouette", "Davies_Bouldin", "Calinski_Harabasz"
             INTO NAME metric VALUE value)""",
    ),
}


def _with(names: list[str], body: str, extra: list[tuple[str, str]] = (), rec: bool = False) -> str:
    """``body`` behind the named inputs and all they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in _CTES[name][0]:
            visit(d)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f'"{n}" AS MATERIALIZED ({_CTES[n][1]})' for n in order]
    loops = ("tree", "climb")  # these refer to themselves
    parts += [f"{n} AS {'' if n in loops else 'MATERIALIZED '}({q})" for n, q in extra]
    return f"WITH {'RECURSIVE ' if rec else ''}{', '.join(parts)} {body}"


def _micro(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda v: round(v::DOUBLE * 1e6)::BIGINT), ',')"


def _unit(v: str) -> str:
    """Unit-length float vector; the zero vector stays."""
    v = f"CAST({v} AS DOUBLE[])"
    norm = f"sqrt(list_inner_product({v}, {v}))"
    return (
        f"list_transform({v}, lambda v: (v / (CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END))::FLOAT)"
    )


_TRIM = "trim(word, ' ' || chr(9) || chr(160))"
_PLACE = "min(row(-frequency, word))"
_SELECT_ALL = (
    f"SELECT {_TRIM} AS w, max(frequency) AS frequency, {_PLACE} AS place FROM dirty "
    "WHERE word IS NOT NULL GROUP BY 1"
)


def _grams(word: str) -> str:
    m = f"('<' || {word} || '>')"
    sizes = ", ".join(
        f"list_transform(generate_series(1, length({m}) - {n - 1}), lambda i: substring({m}, i, {n}))"
        for n in range(3, 7)
    )
    return f"list_distinct(list_concat(flatten([{sizes}]), [{m}]))"


def _subword(words: str) -> list[tuple[str, str]]:
    """Sums of bucket vectors per word of the table ``words``."""
    return [
        ("grams", f"SELECT word_id, word, unnest({_grams('word')}) AS ngram FROM {words}"),
        (
            "buckets",
            """SELECT ngram, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM (
                 SELECT ngram, ('0x' || substr(md5('bucket:' || ngram), 1, 15))::BIGINT % n AS b
                 FROM (SELECT DISTINCT ngram FROM grams), (SELECT count(*) AS n FROM embeddings))
               JOIN embeddings ON vec_id = b""",
        ),
        (
            "sums",
            "SELECT word_id, word, ["
            + ", ".join(f"sum(x[{i}])" for i in range(1, DIM + 1))
            + "] AS f FROM grams JOIN buckets USING (ngram) GROUP BY ALL",
        ),
    ]


_RANKED = (
    "ranked",
    "SELECT row_number() OVER (ORDER BY frequency DESC, word) - 1 AS word_id, word, frequency "
    "FROM lexicon",
)
_TOP_BEFORE = [
    (
        "top",
        """SELECT word, frequency, row_number() OVER (
             ORDER BY frequency DESC NULLS LAST, word ASC NULLS LAST) AS r
           FROM dirty QUALIFY r <= 10000""",
    ),
    (
        "selected",
        f"""SELECT row_number() OVER (ORDER BY min(r)) - 1 AS word_id, {_TRIM} AS word,
              max(frequency) AS frequency
            FROM top WHERE word IS NOT NULL GROUP BY {_TRIM}""",
    ),
]


def _silhouette(base: str, extra: list[tuple[str, str]], per_point: bool = False) -> str:
    """Silhouette over the labeled points in ``base``."""
    steps = extra + [
        ("sizes_c", f"SELECT algorithm, k, cluster, count(*) AS n FROM {base} GROUP BY ALL"),
        (
            "sums_c",
            f"""SELECT a.algorithm, a.k, a.word_id, a.cluster AS own, b.cluster, sum(d) AS s
                FROM {base} a JOIN dist ON src = a.word_id
                JOIN {base} b ON b.word_id = dst AND b.algorithm = a.algorithm AND b.k = a.k
                GROUP BY ALL""",
        ),
        (
            "ab",
            f"""SELECT p.algorithm, p.k, p.word_id, z.n AS cluster_size,
                  coalesce(max(CASE WHEN s.cluster = own THEN s / greatest(z.n - 1, 1) END), 0) AS a,
                  min(CASE WHEN s.cluster <> own THEN s / zc.n END) AS b
                FROM {base} p JOIN sizes_c z USING (algorithm, k, cluster)
                JOIN sums_c s ON s.algorithm = p.algorithm AND s.k = p.k AND s.word_id = p.word_id
                JOIN sizes_c zc ON zc.algorithm = s.algorithm AND zc.k = s.k
                  AND zc.cluster = s.cluster
                GROUP BY ALL""",
        ),
        (
            "sil",
            """SELECT algorithm, k, word_id, cluster_size, a, b,
                 CASE WHEN cluster_size = 1 OR greatest(a, b) = 0 THEN 0
                 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab""",
        ),
    ]
    if per_point:
        body = """SELECT algorithm, k, word_id, cluster_size, round(a, 6) AS a, round(b, 6) AS b,
                    round(silhouette, 6) AS silhouette FROM sil"""
    else:
        body = """SELECT algorithm, k, count(*) AS silhouette_points, round(avg(silhouette), 6) AS silhouette
                  FROM sil GROUP BY ALL"""
    return _with(["asg", "dist"], body, steps)


def _nearest(rows: str, centers: str) -> str:
    """Nearest centre per row; the lower cluster number of equals."""
    return (
        f"SELECT p.word_id, p.x, c.cluster FROM {rows} p CROSS JOIN {centers} c "
        "QUALIFY row_number() OVER (PARTITION BY p.word_id "
        "ORDER BY list_distance(p.x, c.c), c.cluster) = 1"
    )


_LABEL_MEANS = (
    "c0",
    "SELECT cluster, 0::DOUBLE AS seen, c FROM centroids WHERE algorithm = 'label'",
)


def _kmeans(steps: int) -> str:
    parts = [_LABEL_MEANS]
    mean = "[" + ", ".join(f"avg(x[{i}])" for i in range(1, DIM + 1)) + "]"
    for t in range(steps):
        parts.append((f"a{t}", _nearest("points", f"c{t}")))
        parts.append((f"m{t}", f"SELECT cluster, {mean} AS c FROM a{t} GROUP BY cluster"))
        parts.append(
            (
                f"c{t + 1}",
                f"SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{t} o "
                f"LEFT JOIN m{t} m USING (cluster)",
            )
        )
    parts.append(("last", _nearest("points", f"c{steps}")))
    return _with(["points", "centroids"], "SELECT word_id, cluster FROM last", parts)


def _minibatch(steps: int, batch_size: int, shown: str = "SELECT word_id, cluster FROM last") -> str:
    size = f"ceil((SELECT count(*) FROM points) / {batch_size}.0)::BIGINT"
    parts = [
        _LABEL_MEANS,
        (
            "batches",
            f"""SELECT word_id, x, epoch * per + ('0x' || substr(md5('42-' || epoch || ':'
                  || word_id), 1, 15))::BIGINT % per AS step
                FROM points, (SELECT {size} AS per), range({steps}) e(epoch)""",
        ),
    ]
    sums = "[" + ", ".join(f"sum(x[{i}])" for i in range(1, DIM + 1)) + "]"
    for t in range(steps):
        parts.append((f"b{t}", f"SELECT word_id, x FROM batches WHERE step = {t}"))
        parts.append((f"a{t}", _nearest(f"b{t}", f"c{t}")))
        parts.append(
            (f"m{t}", f"SELECT cluster, count(*) AS n, {sums} AS s FROM a{t} GROUP BY cluster")
        )
        parts.append(
            (
                f"c{t + 1}",
                f"""SELECT o.cluster, o.seen + coalesce(m.n, 0) AS seen,
                      CASE WHEN m.n IS NULL THEN o.c ELSE list_transform(list_zip(o.c, m.s),
                        lambda z: z[1] + (z[2] - m.n * z[1]) / (o.seen + m.n)) END AS c
                    FROM c{t} o LEFT JOIN m{t} m USING (cluster)""",
            )
        )
    parts.append(("last", _nearest("points", f"c{steps}")))
    return _with(["points", "centroids"], shown, parts)


def _gmm(steps: int) -> str:
    eps = 10 * 2.220446049250313e-16
    dims = range(1, DIM + 1)

    def params(source: str, r: str) -> str:
        s = ", ".join(f"sum({r} * x[{i}])" for i in dims)
        ss = ", ".join(f"sum({r} * x[{i}] * x[{i}])" for i in dims)
        return (
            f"SELECT j, mass / (SELECT count(*) FROM points) AS weight, "
            f"list_transform(s, lambda v: v / mass) AS mu, "
            f"list_transform(list_zip(s, ss), lambda z: greatest(z[2] / mass - (z[1] / mass) ** 2, 0)"
            f" + 1e-6) AS var FROM (SELECT j, sum({r}) + {eps} AS mass, [{s}] AS s, [{ss}] AS ss "
            f"FROM {source} GROUP BY j)"
        )

    def joint(t: int) -> str:
        return (
            f"SELECT word_id, x, j, ln(weight) - 0.5 * list_sum(list_transform("
            f"list_zip(x, mu, var), lambda z: ln(2 * pi() * z[3]) + (z[1] - z[2]) ** 2 / z[3])) AS lp "
            f"FROM points CROSS JOIN p{t}"
        )

    parts = [("hard", "SELECT word_id, x, label AS j, 1.0::DOUBLE AS r FROM points")]
    parts.append(("p0", params("hard", "r")))
    for t in range(steps):
        parts.append((f"j{t}", joint(t)))
        parts.append(
            (
                f"r{t}",
                f"""SELECT x, j, exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY word_id)
                      AS r FROM (SELECT *, max(lp) OVER (PARTITION BY word_id) AS top FROM j{t})""",
            )
        )
        parts.append((f"p{t + 1}", params(f"r{t}", "r")))
    parts.append((f"j{steps}", joint(steps)))
    body = (
        f"SELECT word_id, j AS cluster FROM j{steps} "
        "QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY lp DESC, j) = 1"
    )
    return _with(["points"], body, parts)


# Rounds of reciprocal-nearest merges; every row is a cluster alive after its round.
_TREE = [
    (
        "tree",
        """
        SELECT 0 AS round, word_id AS id, 1::BIGINT AS n,
          list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) AS s,
          NULL::BIGINT AS "right", NULL::DOUBLE AS height FROM points
        UNION ALL
        SELECT * FROM (
          WITH nn AS (
            SELECT a.id, b.id AS nn,
              round(1 - list_inner_product(a.s, b.s) / (a.n * b.n), 12) AS h
            FROM tree a JOIN tree b ON a.id <> b.id
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY h, b.id) = 1),
          pair AS (
            SELECT p.id AS l, q.id AS r, p.h FROM nn p JOIN nn q ON p.nn = q.id AND q.nn = p.id
            WHERE p.id < q.id)
          SELECT t.round + 1, t.id,
            CASE WHEN p.l IS NULL THEN t.n ELSE t.n + u.n END,
            CASE WHEN p.l IS NULL THEN t.s
              ELSE list_transform(list_zip(t.s, u.s), lambda z: z[1] + z[2]) END,
            p.r, p.h
          FROM tree t LEFT JOIN pair p ON p.l = t.id LEFT JOIN tree u ON u.id = p.r
          WHERE t.id NOT IN (SELECT r FROM pair) AND (SELECT count(*) FROM tree) > 1)
        """,
    ),
    (
        "merges",
        """SELECT id AS "left", "right", height, n AS size FROM tree WHERE height IS NOT NULL""",
    ),
]


def _cut(ks: list[int]) -> str:
    steps = _TREE + [
        ("ks", "SELECT unnest([" + ", ".join(map(str, ks)) + "]) AS k"),
        (
            "kept",
            """SELECT k, "left" AS l, "right" AS r FROM (
                 SELECT *, row_number() OVER (ORDER BY height DESC, "left" DESC, "right" DESC)
                   AS place FROM merges) JOIN ks ON place >= k""",
        ),
        (
            "climb",
            """SELECT k, word_id, word_id AS pos FROM points CROSS JOIN ks
               UNION ALL
               SELECT c.k, c.word_id, l FROM climb c JOIN kept ON kept.k = c.k AND r = pos""",
        ),
        (
            "roots",
            """SELECT k, word_id, pos FROM climb c WHERE NOT EXISTS (
                 SELECT 1 FROM kept WHERE kept.k = c.k AND kept.r = c.pos)""",
        ),
    ]
    body = """SELECT k, word_id, dense_rank() OVER (PARTITION BY k ORDER BY pos) - 1 AS cluster
              FROM roots"""
    return _with(["points"], body, steps, rec=True)


_HEADER = "model, k, \"Algorithm\", metric, round(value, 6) AS value, higher_is_better"
_FOUR = ("WCSS", "Silhouette", "Davies_Bouldin", "Calinski_Harabasz")
_ROUNDED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in _FOUR)
_WITH_SYNSETS = (
    "known",
    """SELECT algorithm, cluster, count(DISTINCT word) AS n_with_synsets
       FROM clusters JOIN synsets USING (word) GROUP BY ALL""",
)


def _coherence_steps(pairs: str, count_zero: bool) -> list[tuple[str, str]]:
    n_pairs = "coalesce(known.n_with_synsets * (known.n_with_synsets - 1) // 2, 0)"
    if not count_zero:
        n_pairs = "coalesce(scored, 0)"
    return [
        _WITH_SYNSETS,
        (
            "scores",
            f"""SELECT algorithm, cluster, n_words, coalesce(n_with_synsets, 0) AS n_with_synsets,
                  {n_pairs}::BIGINT AS n_pairs,
                  CASE WHEN {n_pairs} > 0 THEN coalesce(total, 0) / {n_pairs} END AS coherence
                FROM sizes LEFT JOIN known USING (algorithm, cluster)
                LEFT JOIN (SELECT algorithm, cluster, sum(sim) AS total, count(*) AS scored
                  FROM {pairs} WHERE sim > 0 GROUP BY ALL) USING (algorithm, cluster)""",
        ),
    ]


_SUMMARY = """SELECT algorithm AS "Algorithm",
    round(avg(coherence) FILTER (n_words >= 2), 4) AS "Mean_WordNet_Coherence",
    round(stddev_pop(coherence) FILTER (n_words >= 2), 4) AS "Std_WordNet_Coherence",
    (count(coherence) FILTER (n_words >= 2))::INT AS "Clusters_Evaluated",
    (count(*) - count(coherence) FILTER (n_words >= 2))::INT AS "Clusters_Skipped",
    sum(n_words)::BIGINT AS "Words", sum(n_with_synsets)::BIGINT AS "Words_With_Synsets"
    FROM scores GROUP BY algorithm"""
_COHERENCE = "SELECT * REPLACE (round(coherence, 6) AS coherence) FROM scores"

_BEST_PAIR = [
    (
        "paths",
        """SELECT s1, s2, 1.0::DOUBLE / (1 + min(a.u + b.u)) AS sim FROM (
             SELECT DISTINCT s1, s2 FROM sense_pairs)
           JOIN up a ON a.synset_id = s1 JOIN up b ON b.synset_id = s2 AND b.ancestor = a.ancestor
           GROUP BY ALL""",
    ),
]
_JACCARD = [
    ("distinct_pairs", "SELECT DISTINCT s1, s2 FROM sense_pairs"),
    (
        "shared",
        """SELECT s1, s2, count(*) AS n_both FROM distinct_pairs
           JOIN hypernyms a ON a.synset_id = s1
           JOIN hypernyms b ON b.synset_id = s2 AND b.hypernym_id = a.hypernym_id GROUP BY ALL""",
    ),
    ("hs", "SELECT synset_id, count(*) AS n FROM hypernyms GROUP BY ALL"),
]


def oracle_sql() -> dict[str, str]:
    evaluate = """SELECT algorithm, k, n_points, n_clusters, round(wcss, 6) AS wcss,
        round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin,
        round(calinski_harabasz, 6) AS calinski_harabasz
        FROM (SELECT algorithm, k, sum(n)::BIGINT AS n_points, count(*) AS n_clusters
              FROM cents GROUP BY ALL)
        JOIN wcss_t USING (algorithm, k) JOIN db_t USING (algorithm, k)
        JOIN ch_t USING (algorithm, k) JOIN sil_mean USING (algorithm, k)"""
    sil_parts = _silhouette("asg", []).split("sizes_c AS", 1)[1].rsplit(") SELECT algorithm", 1)[0]
    sil_steps = f"sizes_c AS{sil_parts}), sil_mean AS (SELECT algorithm, k, avg(silhouette) AS silhouette FROM sil GROUP BY ALL)"
    evaluate_sql = _with(
        ["asg", "dist", "cents", "wcss_t", "db_t", "ch_t"], f"§{evaluate}"
    ).replace(" §", f", {sil_steps} ")

    return {
        "lexicon_top_before": _with(["dirty"], "SELECT * FROM selected", _TOP_BEFORE),
        "lexicon_top_after": _with(
            ["dirty", "vocab"],
            """SELECT row_number() OVER (ORDER BY place) - 1 AS word_id, w AS word, frequency
               FROM words SEMI JOIN vocab ON vocab.word = w ORDER BY place LIMIT 20000""",
            [("words", _SELECT_ALL)],
        ),
        "lexicon_top_after_cut": _with(
            ["dirty", "vocab"],
            """SELECT row_number() OVER (ORDER BY place) - 1 AS word_id, w AS word, frequency
               FROM words SEMI JOIN vocab ON vocab.word = w ORDER BY place LIMIT 5000""",
            [("words", _SELECT_ALL)],
        ),
        "lexicon_all": _with(
            ["dirty"],
            """SELECT row_number() OVER (ORDER BY place) - 1 AS word_id, w AS word, frequency
               FROM words""",
            [("words", _SELECT_ALL)],
        ),
        "vocab_semi_join": _with(
            ["lexicon", "vocab"], "SELECT word, frequency FROM lexicon SEMI JOIN vocab USING (word)"
        ),
        "coverage_report": _with(
            ["lexicon", "vocab"],
            """SELECT u AS unique_words, v AS vocab_size, m AS matched_words,
                 u - m AS unmatched_words, round(m::DOUBLE / u, 6) AS coverage FROM (
                 SELECT (SELECT count(*) FROM lexicon) AS u, (SELECT count(*) FROM vocab) AS v,
                   (SELECT count(*) FROM lexicon SEMI JOIN vocab USING (word)) AS m)""",
        ),
        "null_tokens": _with(
            ["dirty"],
            """SELECT CASE WHEN word IN ('nan', 'null', 'n/a') THEN NULL ELSE word END AS word,
                 frequency FROM dirty""",
        ),
        "first_match": _with(
            ["lexicon"],
            """SELECT CASE WHEN word IN ('nan', 'null', 'n/a') THEN NULL ELSE word END AS word,
                 frequency FROM lexicon""",
        ),
        "read_vocab_lines": _with(
            ["dirty"],
            f"""SELECT w AS word, max(r) AS idx FROM (
                  SELECT {_TRIM} AS w, row_number() OVER (ORDER BY {_TRIM}, word) - 1 AS r
                  FROM dirty WHERE word IS NOT NULL) GROUP BY w""",
        ),
        "word_vectors": _with(
            ["lexicon", "vocab", "weights"],
            f"SELECT word_id, word, {_micro(_unit('features'))} AS features "
            "FROM top JOIN weights USING (idx)",
            [
                (
                    "top",
                    """SELECT row_number() OVER (ORDER BY frequency DESC, word) - 1 AS word_id,
                         word, idx FROM lexicon JOIN vocab USING (word)
                         QUALIFY word_id < 20000""",
                )
            ],
        ),
        "char_ngrams": _with(
            ["lexicon"],
            "SELECT ngram, count(*) AS n_words, min(word) AS first_word FROM ("
            f"SELECT word, unnest({_grams('word')}) AS ngram FROM lexicon) GROUP BY ngram",
        ),
        "subword_sum": _with(
            ["lexicon"],
            f"SELECT word_id, word, {_micro('f')} AS features FROM sums",
            [_RANKED, *_subword("ranked")],
        ),
        "subword_embeddings": _with(
            ["dirty"],
            f"SELECT word_id, word, {_micro(_unit('f'))} AS features FROM sums",
            [*_TOP_BEFORE, *_subword("selected")],
        ),
        "masked_mean_pool": "SELECT conv_id AS word_id, array_to_string(list_transform(["
        + ", ".join(
            f"coalesce(sum(embedding[{i}]::DOUBLE) FILTER (role = 'user'), 0)"
            for i in range(1, DIM + 1)
        )
        + "], lambda v: round(v / greatest(count(*) FILTER (role = 'user'), 1e-9) * 1e6)::BIGINT), ',')"
        " AS features FROM conversations JOIN embeddings ON vec_id ="
        " (conv_id * 31 + turn) % (SELECT count(*) FROM embeddings) WHERE turn < 4 GROUP BY conv_id",
        "contextual_embeddings": _with(
            ["lexicon"],
            f"SELECT word_id, word, {_micro(_unit('f'))} AS features FROM pooled",
            [
                _RANKED,
                (
                    "pooled",
                    """SELECT word_id, word, [avg(c), avg(c % 7), avg(c % 11)] AS f FROM (
                         SELECT word_id, word, unnest(list_transform(
                           generate_series(1, least(length(word), 16)),
                           lambda i: unicode(substring(word, i, 1)))) AS c FROM ranked) GROUP BY ALL""",
                ),
            ],
        ),
        "token_truncation": r"""SELECT conv_id, turn, array_to_string(
            (regexp_extract_all(lower(text), '\p{L}+'))[1:16], ' ') AS tokens FROM conversations""",
        "normalized_vectors": _with(
            ["weights"], f"SELECT idx, {_micro(_unit('features'))} AS features FROM weights"
        ),
        "pair_distances": _with(
            ["asg", "centroids"],
            """SELECT word_id, cluster, round(list_distance(x, c), 6) AS l2,
                 round(list_distance(x, c) ** 2, 6) AS sq_l2,
                 round(1 - list_cosine_similarity(x, c), 6) AS cosine,
                 round(list_inner_product(x, c), 6) AS dot
               FROM asg JOIN centroids USING (algorithm, k, cluster) WHERE algorithm = 'label'""",
        ),
        "embeddings_round_trip": "SELECT vec_id AS word_id, 'w' || vec_id AS word, "
        f"{_micro('embedding')} AS features FROM embeddings",
        "cluster_centroids": _with(
            ["centroids"],
            """SELECT algorithm, k, cluster, n, pos - 1 AS pos, round(c[pos], 6) AS value
               FROM centroids, range(1, 65) r(pos)""",
        ),
        "wcss": _with(["wcss_t"], "SELECT algorithm, k, round(wcss, 6) AS wcss FROM wcss_t"),
        "inertia": _with(
            ["asg", "centroids"],
            """SELECT algorithm, k, round(sum(list_distance(x, list_transform(c,
                 lambda v: round(v, 1))) ** 2), 6) AS inertia
               FROM asg JOIN centroids USING (algorithm, k, cluster) GROUP BY ALL""",
        ),
        "silhouette_exact": _silhouette("asg", []),
        "silhouette_samples": _silhouette("asg", [], per_point=True),
        "silhouette_sampled": _silhouette(
            "part_asg",
            [
                ("sampled", _CTES["sampled"][1]),
                ("part_asg", "SELECT * FROM asg SEMI JOIN sampled USING (word_id)"),
            ],
        ),
        "davies_bouldin": _with(
            ["db_t"], "SELECT algorithm, k, round(davies_bouldin, 6) AS davies_bouldin FROM db_t"
        ),
        "calinski_harabasz": _with(
            ["ch_t"],
            "SELECT algorithm, k, round(calinski_harabasz, 6) AS calinski_harabasz FROM ch_t",
        ),
        "cluster_count_check": _with(
            ["asg"],
            """SELECT algorithm, k * 2 AS k, count(DISTINCT cluster) AS n_clusters,
                 greatest(k * 2 - count(DISTINCT cluster), 0) AS shortfall FROM asg
               GROUP BY algorithm, k""",
        ),
        "evaluate_grid": evaluate_sql,
        "knn_graph": _with(["knn"], "SELECT src, dst, rank, round(d, 6) AS distance FROM knn"),
        "normalized_affinity": _with(
            ["knn"],
            """SELECT src, dst, w, a.d AS src_degree, b.d AS dst_degree,
                 round(w / sqrt(a.d * b.d), 6) AS norm_w
               FROM sym JOIN deg a ON a.id = src JOIN deg b ON b.id = dst""",
            [
                (
                    "sym",
                    """SELECT src, dst, sum(0.5::DOUBLE) AS w FROM (SELECT src, dst FROM knn
                       UNION ALL SELECT dst, src FROM knn) GROUP BY ALL""",
                ),
                ("deg", "SELECT src AS id, sum(w) AS d FROM sym GROUP BY ALL"),
            ],
        ),
        "kmeans_fixed_init": _kmeans(5),
        "minibatch_kmeans": _minibatch(8, 100),
        # one file is one batch
        "minibatch_stream": _minibatch(
            1, 10**9,
            f"""SELECT cluster, seen::BIGINT AS seen, place, round(c[place], 6) AS value
                FROM c1, unnest(range(1, {DIM + 1})) AS p(place)""",
        ),
        "gmm_diag": _gmm(3),
        "dendrogram": _with(
            ["points"],
            'SELECT "left", "right", round(height, 6) AS height, size FROM merges',
            _TREE,
            rec=True,
        ),
        "agglomerative": _cut([5, 8, 20]),
        "synset_pairs": _with(["sense_pairs"], "SELECT * FROM sense_pairs"),
        "hypernym_jaccard": _with(
            ["sense_pairs", "hypernyms"],
            """SELECT s1, s2, round(coalesce(n_both::DOUBLE / (a.n + b.n - n_both), 0), 6) AS jaccard
               FROM distinct_pairs LEFT JOIN shared USING (s1, s2)
               LEFT JOIN hs a ON a.synset_id = s1 LEFT JOIN hs b ON b.synset_id = s2""",
            _JACCARD,
        ),
        "jaccard_arrays": r"""WITH t AS (SELECT conv_id, turn,
              regexp_extract_all(lower(text), '\p{L}+') AS t FROM conversations)
            SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE
              len(list_intersect(a.t, b.t))::DOUBLE
              / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS jaccard
            FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
        "path_similarity": _with(
            ["sense_pairs", "up"],
            """SELECT s1, s2, round(sim, 6) AS path_sim
               FROM (SELECT DISTINCT s1, s2 FROM sense_pairs) LEFT JOIN paths USING (s1, s2)""",
            _BEST_PAIR,
        ),
        "path_similarity_deep": """WITH RECURSIVE h AS (
             SELECT 'p' || p_partkey AS synset_id, CASE WHEN p_partkey % 40 = 39
               THEN 'g' || (p_partkey // 80) ELSE 'p' || (p_partkey + 1) END AS hypernym_id FROM part),
           q AS (SELECT 'p' || p_partkey AS s1, 'p' || (p_partkey + 40) AS s2 FROM part
             WHERE p_partkey % 80 < 40),
           r AS (SELECT x AS synset_id, x AS ancestor, 0 AS u
               FROM (SELECT s1 AS x FROM q UNION SELECT s2 FROM q)
             UNION ALL SELECT r.synset_id, h.hypernym_id, u + 1 FROM r JOIN h ON h.synset_id = r.ancestor)
           SELECT s1, s2, round(1.0::DOUBLE / (1 + min(a.u + b.u)), 6) AS path_sim FROM q
             LEFT JOIN r a ON a.synset_id = s1
             LEFT JOIN r b ON b.synset_id = s2 AND b.ancestor = a.ancestor GROUP BY s1, s2""",
        "pair_similarity": _with(
            ["sense_pairs", "up"],
            """SELECT w1, w2, round(max(sim), 6) AS sim FROM pairs
               LEFT JOIN sense_pairs USING (w1, w2) LEFT JOIN paths USING (s1, s2) GROUP BY ALL""",
            _BEST_PAIR,
        ),
        "cluster_coherence": _with(
            ["path_pairs", "sizes"], _COHERENCE, _coherence_steps("path_pairs", False)
        ),
        "cluster_coherence_jaccard": _with(
            ["jaccard_pairs", "sizes", "synsets"],
            _COHERENCE,
            _coherence_steps("jaccard_pairs", True),
        ),
        "coherence_summary": _with(
            ["jaccard_pairs", "sizes", "synsets"],
            _SUMMARY,
            _coherence_steps("jaccard_pairs", False),
        ),
        "coherence_chart_data": _with(
            ["path_pairs", "sizes"],
            'SELECT * EXCLUDE ("Words", "Words_With_Synsets") FROM summary '
            'WHERE "Mean_WordNet_Coherence" IS NOT NULL',
            [*_coherence_steps("path_pairs", False), ("summary", _SUMMARY)],
        ),
        "metrics_long": _with(["long"], f"SELECT {_HEADER} FROM long"),
        "metric_curves": _with(
            ["long"],
            """SELECT metric, "Algorithm", k, higher_is_better, round(avg(value), 6) AS value
               FROM long GROUP BY ALL""",
        ),
        "best_by_metric": _with(
            ["long"],
            f"""SELECT {_HEADER}, rank() OVER (PARTITION BY model, metric, k ORDER BY
                  CASE WHEN higher_is_better THEN -l.value ELSE l.value END) AS place
                FROM long l""",
        ),
        "metric_deltas": _with(
            ["long"],
            f"""SELECT {_HEADER}, round(delta, 6) AS delta,
                  coalesce(bool_and(delta >= 0) OVER c, true) AS rises,
                  coalesce(bool_and(delta <= 0) OVER c, true) AS falls
                FROM (SELECT *, value - lag(value) OVER (
                  PARTITION BY model, metric, "Algorithm" ORDER BY k) AS delta FROM long)
                WINDOW c AS (PARTITION BY model, metric, "Algorithm")""",
        ),
        "compare_models": _with(
            ["metrics"],
            f"""SELECT model, k, "Algorithm", {_ROUNDED},
                  round("WCSS" / n, 6) AS wcss_per_point
                FROM metrics JOIN (SELECT l_linestatus AS model, count(*) AS n FROM lineitem
                  GROUP BY ALL) USING (model)""",
        ),
        "metrics_round_trip": _with(
            ["metrics"], f"""SELECT model, k, "Algorithm", {_ROUNDED} FROM metrics"""
        ),
        "read_write_assignments": _with(
            ["asg"], "SELECT algorithm, k, word_id, cluster FROM asg"
        ),
        "assignment_files": _with(
            ["asg"], "SELECT algorithm, 'w' || word_id AS word, cluster FROM asg"
        ),
    }
