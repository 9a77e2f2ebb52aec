"""DuckDB SQL with the same meaning as the queries in the registry, for checking results."""

from __future__ import annotations

from cadenza.schema import FEATURES_4, FEATURES_9, FEATURES_11

_POSITIONS = ["danceability", "acousticness", "instrumentalness", "loudness"]
_POSITIONS += [f for f in FEATURES_9 if f not in _POSITIONS]
_LIMIT = 40  # distinct-track limit used by the registry


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def _rs(features: list[str], prefix: str = "") -> str:
    return ", ".join(_r(f"CAST({prefix}{f} AS DOUBLE)", f) for f in features)


TRACKS = (
    "tracks AS (SELECT p_partkey AS id, p_name AS name, '[''' || p_brand || ''']' AS artists, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(_POSITIONS))
    + ", label AS key, p_size % 2 AS mode FROM part JOIN embeddings ON p_partkey = vec_id)"
)
LISTENS = (
    "listens AS (SELECT o_custkey AS user_id, l_partkey AS track_id, l_quantity AS playcount, "
    "l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
MUSIC = "music AS (SELECT p_partkey AS track_id, p_name AS name, p_brand AS artist FROM part)"
SCROBBLES = (
    "scrobbles AS (SELECT p_brand AS artist, p_name AS track FROM lineitem "
    "JOIN part ON l_partkey = p_partkey)"
)
PLAYS_MBID = (
    "plays AS (SELECT nullif(event_type, 'error') AS track_mbid, event_id, user_id, value FROM events)"
)
REQUESTS = "requests AS (SELECT p_partkey AS request_id, p_name AS title, p_brand AS artist FROM part)"
MISSPELT = (
    "requests AS (SELECT p_partkey AS request_id, "
    "upper(substr(p_name, 1, 1) || substr(p_name, 3)) AS title, p_brand AS artist FROM part)"
)
DEDUP = (
    LISTENS
    + ", active AS (SELECT user_id FROM listens GROUP BY user_id HAVING count(*) >= 16), "
    "first_plays AS (SELECT user_id, track_id, playcount FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, track_id ORDER BY l_orderkey, l_linenumber, playcount) AS nth FROM listens "
    "WHERE user_id IN (SELECT user_id FROM active)) WHERE nth = 1)"
)
MATRIX = (
    DEDUP
    + ", broad AS (SELECT user_id FROM first_plays GROUP BY user_id "
    f"HAVING count(track_id) > {_LIMIT}), "
    "matrix AS (SELECT track_id, user_id, avg(playcount) AS playcount FROM first_plays "
    "WHERE user_id IN (SELECT user_id FROM broad) GROUP BY track_id, user_id), "
    "norms AS (SELECT track_id, sqrt(sum(playcount * playcount)) AS norm, count(*) AS listeners "
    "FROM matrix GROUP BY track_id)"
)
METADATA = (
    MUSIC
    + ", metadata AS (SELECT * FROM music WHERE track_id IN (SELECT track_id FROM matrix))"
)
NEIGHBOURS = (
    "overlap AS (SELECT a.track_id AS seed_id, b.track_id AS track_id, "
    "sum(a.playcount * b.playcount) AS dot FROM matrix a JOIN matrix b ON a.user_id = b.user_id "
    "AND a.track_id <> b.track_id GROUP BY 1, 2), "
    "near AS (SELECT s.track_id AS seed_id, t.track_id, "
    "CASE WHEN o.dot > 0 THEN floor(o.dot / (s.norm * t.norm) * 1e12 + 0.5) / 1e12 ELSE 0 END AS score "
    "FROM norms s JOIN norms t ON s.track_id <> t.track_id LEFT JOIN overlap o "
    "ON o.seed_id = s.track_id AND o.track_id = t.track_id), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, track_id) AS rank "
    "FROM near)"
)
TOP_TRACK_PARTS = (
    "sums AS (SELECT user_id, track_id, sum(playcount) AS plays FROM listens GROUP BY 1, 2), "
    "top_tracks AS (SELECT user_id, CAST(place - 1 AS INTEGER) AS pos, track_id, p_name AS name, "
    "p_brand AS artist FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, "
    "track_id) AS place FROM sums) JOIN part ON p_partkey = track_id WHERE place <= 20)"
)
TOP_TRACKS = f"{LISTENS}, {TOP_TRACK_PARTS}"
HITS = (
    "found AS (SELECT p_name, p_brand, min(p_partkey) AS found FROM part WHERE p_size > 10 GROUP BY 1, 2), "
    "hits AS (SELECT p.p_partkey AS request_id, p.p_name AS title, p.p_brand AS artist, f.found AS track_id "
    "FROM part p LEFT JOIN found f ON f.p_name = p.p_name AND f.p_brand = p.p_brand)"
)
HISTORY = (
    TRACKS
    + ", "
    + SCROBBLES
    + ", "
    + HITS
    + ", counts AS (SELECT artist, track, count(*) AS count FROM scrobbles "
    "WHERE artist IS NOT NULL AND track IS NOT NULL GROUP BY 1, 2), "
    "songs200 AS (SELECT * FROM counts ORDER BY count DESC, artist, track LIMIT 200), "
    "ids AS (SELECT artist, title AS track, min(track_id) AS track_id FROM hits GROUP BY 1, 2), "
    "history AS (SELECT s.artist, s.track, s.count, CAST(i.track_id AS VARCHAR) AS spotify_id, "
    + ", ".join(f"t.{f}" for f in FEATURES_11)
    + " FROM songs200 s LEFT JOIN ids i ON i.artist = s.artist AND i.track = s.track "
    "LEFT JOIN tracks t ON t.id = i.track_id), "
    "heard AS (SELECT * FROM history WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES_11) + "), "
    "songs AS (SELECT *, substr(artists, 3, length(artists) - 4) AS artist, name AS track FROM tracks), "
    "unheard AS (SELECT s.* FROM songs s WHERE NOT EXISTS (SELECT 1 FROM heard h "
    "WHERE h.artist = s.artist AND h.track = s.track))"
)
MATCHES = (
    "matches AS (SELECT r.request_id, min(t.id) AS track_id FROM requests r JOIN tracks t "
    "ON lower(t.name) = lower(r.title) AND contains(lower(t.artists), lower(r.artist)) GROUP BY 1)"
)
RESOLVED = (
    TRACKS
    + ", "
    + REQUESTS
    + ", "
    + MATCHES
    + ", "
    + HITS
    + ", external AS (SELECT p_partkey AS track_id, p_size / 50.0 AS danceability, "
    "p_retailprice / 2000 AS acousticness, coalesce(CASE WHEN p_type <> 'PROMO' THEN p_size / 100.0 END, 0) "
    "AS instrumentalness, -CAST(p_size AS DOUBLE) AS loudness FROM part WHERE p_size <= 40), "
    "resolved AS (SELECT r.request_id, r.title, r.artist, "
    "CASE WHEN m.track_id IS NOT NULL THEN 'local' WHEN e.track_id IS NOT NULL THEN 'external' "
    "ELSE 'not_found' END AS status, coalesce(m.track_id, e.track_id) AS track_id, "
    + ", ".join(f"coalesce(t.{f}, e.{f}) AS {f}" for f in FEATURES_4)
    + " FROM requests r LEFT JOIN matches m ON m.request_id = r.request_id "
    "LEFT JOIN tracks t ON t.id = m.track_id "
    "LEFT JOIN hits h ON h.request_id = r.request_id AND m.track_id IS NULL "
    "LEFT JOIN external e ON e.track_id = h.track_id)"
)


def _z(features: list[str], source: str, extra: str, name: str) -> str:
    """Rows of ``source`` standardised by the statistics of ``tracks``."""
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    cols = ", ".join(
        f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS z{i}" for i, f in enumerate(features)
    )
    return f"{name} AS (SELECT {extra}, {cols} FROM {source}, (SELECT {stats} FROM tracks))"


def _nearest(
    features: list[str],
    source: str,
    n: int,
    metric: str,
    out: str = "best",
    skip_title: bool = False,
    skip_self: bool = False,
) -> str:
    """CTEs ending in ``out(request_id, rank, track_id, name, artists, score)``."""
    k = range(len(features))
    if metric == "euclidean":
        score = "sqrt(" + " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in k) + ")"
        order = "score, track_id"
    else:
        dot = " + ".join(f"a.z{i} * b.z{i}" for i in k)
        na = "sqrt(" + " + ".join(f"a.z{i} * a.z{i}" for i in k) + ")"
        nb = "sqrt(" + " + ".join(f"b.z{i} * b.z{i}" for i in k) + ")"
        score = f"CASE WHEN {na} * {nb} = 0 THEN 0 ELSE ({dot}) / ({na} * {nb}) END"
        order = "score DESC, track_id"
    where = []
    if skip_title:
        where.append("lower(a.title) <> lower(b.name)")
    if skip_self:
        where.append("a.track_id <> b.id")
    condition = " AND ".join(where) or "true"
    return (
        _z(features, source, "request_id, title, track_id", f"{out}_a")
        + ", "
        + _z(features, "tracks", "id, name, artists", f"{out}_b")
        + f", {out}_q AS (SELECT min(request_id) AS query_id, title, track_id, "
        + ", ".join(f"z{i}" for i in k)
        + f" FROM {out}_a GROUP BY ALL)"
        + f", {out}_s AS (SELECT query_id, b.id AS track_id, b.name, b.artists, {score} AS score "
        f"FROM {out}_q a, {out}_b b WHERE {condition})"
        + f", {out}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank "
        f"FROM {out}_s QUALIFY rank <= {n})"
        + f", {out} AS (SELECT a.request_id, CAST(r.rank AS INTEGER) AS rank, r.track_id, r.name, "
        f"r.artists, r.score FROM {out}_a a JOIN {out}_q q ON a.title = q.title AND a.track_id = q.track_id "
        + " ".join(f"AND a.z{i} = q.z{i}" for i in k)
        + f" JOIN {out}_r r ON r.query_id = q.query_id)"
    )


_BARE = "replace(replace(replace(artists, '[', ''), ']', ''), '''', '')"
_SELF = "(SELECT id AS request_id, name AS title, id AS track_id, {f} FROM tracks)"


def _self(features: list[str]) -> str:
    return _SELF.format(f=", ".join(features))


_BY_LINE = f"chr(9) || name || ' by ' || {_BARE} AS line"
_SHOWN = "SELECT request_id, rank, track_id, name, artists, " + _r("score", "score")

_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
_CLEAN = "regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g')"


def _masks(text: str) -> str:
    """Per alphabet character, a bit per place where it occurs."""
    bit = (
        f"CASE WHEN substr({text}, CAST(i AS INTEGER), 1) = c THEN CAST(1 AS HUGEINT) "
        "<< CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END"
    )
    return (
        f"list_transform(string_split('{_ALPHABET}', ''), lambda c: coalesce(list_sum(list_transform("
        f"range(1, length({text}) + 1), lambda i: {bit})), CAST(0 AS HUGEINT)))"
    )


def _codes(text: str) -> str:
    return (
        f"list_transform(range(1, length({text}) + 1), "
        f"lambda i: strpos('{_ALPHABET}', substr({text}, CAST(i AS INTEGER), 1)))"
    )


_RATIO = (
    "CASE WHEN qn = 0 OR cn = 0 THEN 0 ELSE CAST(round_even(100 * (CAST(2 AS DOUBLE) * "
    "(qn - bit_count(list_reduce(list_transform(codes, lambda k: CAST(masks[k] AS HUGEINT)), "
    "lambda v, h: ((v + (v & h)) | (v & (ones - h))) & ones, ones))) / (qn + cn)), 0) AS INTEGER) END"
)


def _fuzzy(asked: str, titles: str) -> str:
    """CTEs ending in ``matched(request_id, track_id, match_score, is_weak_match)``."""
    return (
        f"asked AS (SELECT request_id, {_CLEAN.format('search_text')} AS clean FROM ({asked})), "
        f"known AS (SELECT {_CLEAN.format('search_text')} AS clean, min(track_id) AS track_id "
        f"FROM ({titles}) GROUP BY 1), "
        "masked AS (SELECT clean, length(clean) AS qn, "
        f"(CAST(1 AS HUGEINT) << length(clean)) - 1 AS ones, {_masks('clean')} AS masks "
        "FROM (SELECT DISTINCT clean FROM asked)), "
        f"coded AS (SELECT track_id, length(clean) AS cn, {_codes('clean')} AS codes FROM known), "
        f"rated AS (SELECT clean, track_id, {_RATIO} AS score FROM masked, coded), "
        "winners AS (SELECT clean, track_id, score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY clean ORDER BY score DESC, track_id) AS nth FROM rated) WHERE nth = 1), "
        "matched AS (SELECT request_id, track_id, score AS match_score, score < 40 AS is_weak_match "
        "FROM asked JOIN winners USING (clean))"
    )


_BY_KEY = (
    "SELECT request_id, title || ' by ' || artist AS search_text FROM {0}",
    "SELECT track_id, name || ' by ' || artist AS search_text FROM {0}",
)
_TITLE_KEY = (
    "SELECT request_id, title AS search_text FROM {0}",
    "SELECT track_id, name AS search_text FROM {0}",
)


def _fuzzy_on(requests: str, titles: str, key: tuple[str, str] = _BY_KEY) -> str:
    return _fuzzy(key[0].format(requests), key[1].format(titles))


def _hash(seed: int, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


_TRAINING = (
    "training AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY artist, track, id NULLS FIRST) AS row_no FROM ("
    "SELECT CAST(NULL AS BIGINT) AS id, artist, track, count AS label, {f} FROM heard UNION ALL "
    "SELECT id, artist, track, 0, {f} FROM (SELECT *, row_number() OVER (ORDER BY {h}, id) AS nth FROM unheard) "
    "WHERE nth <= (SELECT count(*) FROM heard)))"
).format(f=", ".join(FEATURES_11), h="md5('7|' || id)")


def _grown(train: str, asked: str, trees: int, deepest: int = 60) -> str:
    """CTEs that grow a forest level by level: ``steps`` has every node that a row passes, asked rows with weight 0.

    ``train`` has run, row_no, label and the features, ``asked`` run, row_no (below 0) and the features.
    """
    cells = " UNION ALL ".join(
        f"SELECT run, row_no, {i} AS feature, CAST({f} AS DOUBLE) AS value FROM {t}"
        for t in (train, asked)
        for i, f in enumerate(FEATURES_11)
    )
    draw = "('0x' || substr(md5('42|' || run || '|' || tree || '|' || row_no), 1, 15))::BIGINT"
    return f"""
        cells AS MATERIALIZED ({cells}),
        sizes AS (SELECT run, count(*) AS size FROM {train} GROUP BY run),
        bags AS MATERIALIZED (
            SELECT run, tree, drawn AS row_no, count(*) AS w
            FROM (SELECT run, tree, {draw} % size + 1 AS drawn FROM {train} JOIN sizes USING (run), range(1, {trees + 1}) AS t(tree))
            GROUP BY ALL
        ),
        steps AS (
            SELECT run, tree, 1::BIGINT AS node, row_no, w, label::DOUBLE AS label FROM bags JOIN {train} USING (run, row_no)
            UNION ALL
            SELECT run, tree, 1, row_no, 0, 0 FROM {asked}, range(1, {trees + 1}) AS t(tree)
            UNION ALL
            SELECT s.run, s.tree, 2 * s.node + (c.value > b.threshold)::BIGINT, s.row_no, s.w, s.label
            FROM steps s JOIN (
                SELECT run, tree, node, feature, CASE WHEN (value + above) / 2 < above THEN (value + above) / 2 ELSE value END AS threshold
                FROM (
                    SELECT run, tree, node, feature, value, lead(value) OVER line AS above,
                           sum(w) OVER line AS l, sum(wy) OVER line AS ly, sum(w) OVER whole AS n, sum(wy) OVER whole AS total,
                           min(low) OVER whole AS low, max(high) OVER whole AS high
                    FROM (
                        SELECT s.run, s.tree, s.node, c.feature, c.value, sum(s.w) AS w, sum(s.w * s.label) AS wy,
                               min(s.label) AS low, max(s.label) AS high
                        FROM steps s JOIN cells c ON c.run = s.run AND c.row_no = s.row_no
                        WHERE s.w > 0 AND s.node < {1 << deepest} GROUP BY ALL
                    )
                    WINDOW line AS (PARTITION BY run, tree, node, feature ORDER BY value),
                           whole AS (PARTITION BY run, tree, node, feature)
                )
                WHERE above IS NOT NULL AND low < high
                QUALIFY row_number() OVER (PARTITION BY run, tree, node
                    ORDER BY ly * ly / l + (total - ly) * (total - ly) / (n - l) DESC, feature, value) = 1
            ) b ON b.run = s.run AND b.tree = s.tree AND b.node = s.node
            JOIN cells c ON c.run = s.run AND c.row_no = s.row_no AND c.feature = b.feature
        ),
        leaves AS (
            SELECT run, tree, node, sum(w * label) / sum(w) AS value, sum(w)::BIGINT AS n
            FROM steps WHERE w > 0 GROUP BY run, tree, node
        ),
        predicted AS (
            SELECT run, row_no, sum(value) / {trees} AS predicted_count
            FROM (SELECT run, tree, row_no, max(node) AS node FROM steps WHERE w = 0 GROUP BY ALL)
            JOIN leaves USING (run, tree, node) GROUP BY run, row_no
        )
    """


def _evaluated(runs: int, negatives: bool) -> str:
    """CTEs up to ``errors`` (run, mse) of repeated sampling, splitting, fitting and scoring; run r has seed r - 1."""
    f = ", ".join(FEATURES_11)
    drawn = (
        f"UNION ALL SELECT run, id, artist, track, 0, {f} FROM (SELECT *, row_number() OVER (PARTITION BY run "
        "ORDER BY md5((run - 1) || '|' || id), id) AS nth FROM unheard, runs) WHERE nth <= (SELECT count(*) FROM heard)"
    )
    return f"""{HISTORY}, runs AS (SELECT unnest(range(1, {runs + 1})) AS run),
        pool AS (SELECT run, NULL::BIGINT AS id, artist, track, count AS label, {f} FROM heard, runs {drawn if negatives else ""}),
        ranked AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5(concat_ws('|', run - 1, artist, track, id)), artist, track, id NULLS FIRST)
                          <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY run)) AS is_test
            FROM pool
        ),
        train AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY artist, track, id NULLS FIRST) AS row_no FROM ranked WHERE NOT is_test
        ),
        asked AS MATERIALIZED (
            SELECT *, -row_number() OVER (PARTITION BY run ORDER BY artist, track, id NULLS FIRST) AS row_no FROM ranked WHERE is_test
        ),
        {_grown("train", "asked", 200)},
        errors AS (SELECT run, avg((label - predicted_count) ** 2) AS mse FROM asked JOIN predicted USING (run, row_no) GROUP BY run)
    """


def _lloyd(ks: str, restarts: int = 10, seed: int = 64) -> str:
    """CTEs up to ``fitted`` (k, restart, inertia) and ``finals`` (their centres): steps from hashed starts until none moves."""
    z = ["z0", "z1", "z2", "z3"]
    away = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in z)
    near = (
        f"SELECT c.k, c.restart, c.step, p.id, arg_min(c.cluster, ({away}, c.cluster)) AS cluster, min({away}) AS away, "
        + ", ".join(f"any_value(p.{c}) AS {c}" for c in z)
        + " FROM {centres} c, scaled p GROUP BY c.k, c.restart, c.step, p.id"
    )
    moved = ", ".join(f"coalesce(m.{c}, c.{c}) AS {c}" for c in z)
    shift = " + ".join(f"(coalesce(m.{c}, c.{c}) - c.{c}) ** 2" for c in z)
    return f"""{TRACKS}, {_z(FEATURES_4, 'tracks', 'id', 'scaled_rows')}, scaled AS MATERIALIZED (SELECT * FROM scaled_rows),
        drawn AS (
            SELECT restart, {", ".join(z)}, row_number() OVER (PARTITION BY restart
                ORDER BY md5(({seed} + restart) || '|' || id), id) AS nth
            FROM scaled, range({restarts}) AS r(restart)
        ),
        centres AS (
            SELECT k, restart, 0 AS step, nth AS cluster, {", ".join(z)} FROM drawn, ({ks}) WHERE nth <= k
            UNION ALL
            SELECT k, restart, step + 1, cluster, {", ".join(z)} FROM (
                SELECT c.k, c.restart, c.step, c.cluster, {moved}, max(sqrt({shift})) OVER (PARTITION BY c.k, c.restart) AS shift
                FROM centres c LEFT JOIN (
                    SELECT k, restart, cluster, {", ".join(f"avg({c}) AS {c}" for c in z)}
                    FROM ({near.format(centres="centres")}) GROUP BY k, restart, cluster
                ) m ON m.k = c.k AND m.restart = c.restart AND m.cluster = c.cluster
            ) WHERE shift > 1e-9 AND step < 300
        ),
        finals AS MATERIALIZED (SELECT * FROM centres QUALIFY step = max(step) OVER (PARTITION BY k, restart)),
        fitted AS (SELECT k, restart, sum(away) AS inertia FROM ({near.format(centres="finals")}) GROUP BY k, restart)
    """


_SQUARE = [(i, j) for i in range(4) for j in range(4)]


def _projector(source: str, name: str) -> str:
    """CTEs ``name`` (m00..m33): the projector on the first axis of the symmetric matrix in ``source``, by squaring it."""
    trace = " + ".join(f"m{i}{i}" for i in range(4))
    cells = ", ".join(f"{' + '.join(f'm{i}{k} * m{k}{j}' for k in range(4))} AS m{i}{j}" for i, j in _SQUARE)
    scaled = ", ".join(f"m{i}{j} / ({trace}) AS m{i}{j}" for i, j in _SQUARE)
    names = ", ".join(f"m{i}{j}" for i, j in _SQUARE)
    return f"""{name}_steps AS (
            SELECT 0 AS step, {scaled} FROM {source}
            UNION ALL
            SELECT step + 1, {scaled} FROM (SELECT step, {cells} FROM {name}_steps WHERE step < 60)
        ),
        {name} AS MATERIALIZED (SELECT {names} FROM {name}_steps WHERE step = 60)"""


def _axis(projector: str, name: str) -> str:
    """CTE ``name`` (v0..v3): the axis itself, its largest coefficient positive."""
    row = {i: ", ".join(f"m{i}{j} / sqrt(m{i}{i}) AS v{j}" for j in range(4)) for i in range(4)}
    largest = "greatest(m00, m11, m22, m33)"
    pick = " UNION ALL ".join(f"SELECT {i} AS lead, {row[i]} FROM {projector} WHERE m{i}{i} = {largest}" for i in range(4))
    return f"{name} AS (SELECT * FROM ({pick}) ORDER BY lead LIMIT 1)"


def _flat() -> str:
    means = ", ".join(f"avg({f}) AS a{i}" for i, f in enumerate(FEATURES_4))
    moments = ", ".join(f"covar_pop({FEATURES_4[i]}, {FEATURES_4[j]}) AS m{i}{j}" for i, j in _SQUARE)
    value = " + ".join(f"p.m{i}{j} * c.m{i}{j}" for i, j in _SQUARE)  # the eigenvalue is the trace of the product
    rest = ", ".join(f"c.m{i}{j} - ({value}) * p.m{i}{j} AS m{i}{j}" for i, j in _SQUARE)

    def along(axis: str) -> str:
        return " + ".join(f"({f} - a{i}) * {axis}.v{i}" for i, f in enumerate(FEATURES_4))

    return f"""WITH RECURSIVE {TRACKS}, means AS (SELECT {means} FROM tracks), moments AS (SELECT {moments} FROM tracks),
        {_projector("moments", "first_of")}, {_axis("first_of", "one")},
        deflated AS (SELECT {rest} FROM moments c, first_of p), {_projector("deflated", "second_of")}, {_axis("second_of", "two")}
        SELECT id, {_r(along("one"), "pc1")}, {_r(along("two"), "pc2")} FROM tracks, means, one, two"""


def _top_requests(features: list[str]) -> str:
    return (
        "(SELECT user_id * 100 + pos AS request_id, p.name AS title, p.track_id, "
        + ", ".join(f"t.{f}" for f in features)
        + " FROM top_tracks p JOIN tracks t ON t.id = p.track_id)"
    )


ORACLE: dict[str, str] = {
    "catalogue_scan": f"WITH {TRACKS} SELECT id, name, artists, {_rs(FEATURES_11)} FROM tracks",
    "feature_set_4": f"WITH {TRACKS} SELECT id, {_rs(FEATURES_4)} FROM tracks",
    "feature_set_9": f"WITH {TRACKS} SELECT id, {_rs(FEATURES_9)} FROM tracks",
    "songs_by_first_artist": f"WITH {TRACKS} SELECT id, substr(artists, 3, length(artists) - 4) AS artist, "
    f"trim(name) AS track, {_rs(FEATURES_11)} FROM tracks",
    "tidy_headers": f"WITH {SCROBBLES} SELECT artist, track, count(*) AS plays FROM scrobbles GROUP BY 1, 2",
    "category_codes": f"WITH {LISTENS} SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS "
    "user_id_code FROM (SELECT DISTINCT 'u' || user_id AS user_id FROM listens)",
    "table_counts": f"WITH {TRACKS}, {LISTENS} SELECT count(*) AS n_rows, count(*) = 0 AS is_empty, "
    "'tracks' AS name FROM tracks UNION ALL SELECT count(*), count(*) = 0, 'listens' FROM listens "
    "UNION ALL SELECT count(*), count(*) = 0, 'nothing' FROM tracks WHERE id < 0",
    "catalogue_clean": "SELECT id, row_a, row_b, name, artists, tempo FROM (SELECT *, row_number() OVER "
    "(PARTITION BY id ORDER BY row_a, row_b, name NULLS FIRST, artists, tempo) AS nth FROM (SELECT "
    "l_partkey AS id, l_orderkey AS row_a, l_linenumber AS row_b, nullif(l_returnflag, 'N') AS name, "
    "l_linestatus AS artists, l_quantity AS tempo FROM lineitem)) WHERE nth = 1 AND name IS NOT NULL",
    "listens_dedup": f"WITH {LISTENS} SELECT user_id, track_id, playcount FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, track_id ORDER BY l_orderkey, l_linenumber, playcount) AS nth FROM listens) "
    "WHERE nth = 1",
    "plays_with_key": f"WITH {PLAYS_MBID} SELECT * FROM plays WHERE track_mbid IS NOT NULL",
    "plays_with_listen_count": f"WITH {PLAYS_MBID} SELECT p.*, c.listens FROM plays p LEFT JOIN (SELECT "
    "track_mbid, count(*) AS listens FROM plays GROUP BY 1) c ON c.track_mbid = p.track_mbid",
    "plays_one_per_key": f"WITH {PLAYS_MBID} SELECT track_mbid, event_id, user_id, value, count FROM (SELECT "
    "*, count(*) OVER (PARTITION BY track_mbid) AS count, row_number() OVER (PARTITION BY track_mbid "
    "ORDER BY event_id) AS nth FROM plays WHERE track_mbid IS NOT NULL) WHERE nth = 1",
    "plays_separated": f"WITH {PLAYS_MBID}, firsts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY "
    "track_mbid) AS count, row_number() OVER (PARTITION BY track_mbid ORDER BY event_id) AS nth FROM plays "
    "WHERE track_mbid IS NOT NULL) WHERE nth = 1) SELECT track_mbid, event_id, user_id, value, count, "
    f"row_number() OVER (ORDER BY {_hash(64, 'track_mbid')}, track_mbid) <= "
    "ceil(0.2 * count(*) OVER ()) AS is_test FROM firsts",
    "metadata_lookup": f"WITH {MUSIC} SELECT * FROM music WHERE track_id IN (SELECT l_partkey FROM lineitem)",
    "metadata_missing": f"WITH {TRACKS} SELECT DISTINCT l_partkey AS id FROM lineitem "
    "WHERE l_partkey NOT IN (SELECT id FROM tracks)",
    "heard_pairs": f"WITH {SCROBBLES} SELECT DISTINCT artist, track FROM scrobbles",
    "listens_with_metadata": f"WITH {LISTENS}, {TRACKS} SELECT user_id, track_id, playcount, name, artists "
    "FROM listens LEFT JOIN tracks ON id = track_id",
    "missing_values": "SELECT l_returnflag, l_linenumber <= 2 AS gap, count(*) AS n, sum(CASE WHEN "
    "l_linenumber <= 2 THEN 0 ELSE l_quantity END) AS tempo_sum FROM lineitem GROUP BY 1, 2",
    "user_row_counts": f"WITH {LISTENS} SELECT user_id, count(*) AS n FROM listens GROUP BY 1",
    "active_users": f"WITH {LISTENS} SELECT user_id, count(*) AS rows FROM listens GROUP BY 1 "
    "HAVING count(*) >= 16",
    "broad_users": f"WITH {LISTENS} SELECT user_id, count(DISTINCT track_id) AS tracks FROM listens "
    f"GROUP BY 1 HAVING count(DISTINCT track_id) > {_LIMIT}",
    "listens_of_active_users": f"WITH {LISTENS} SELECT user_id, track_id, playcount FROM listens WHERE "
    "user_id IN (SELECT user_id FROM listens GROUP BY 1 HAVING count(*) >= 16)",
    "interaction_matrix": f"WITH {MATRIX} SELECT track_id, user_id, playcount FROM matrix",
    "mean_playcounts": f"WITH {LISTENS} SELECT track_id, user_id, {_r('avg(playcount)', 'playcount')} "
    "FROM listens GROUP BY 1, 2",
    "track_norms": f"WITH {MATRIX} SELECT track_id, {_r('norm', 'norm')}, listeners FROM norms",
    "track_metadata": f"WITH {MATRIX}, {METADATA} SELECT track_id, name, artist FROM metadata",
    "text_forms": "SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capitalised, "
    "p_name AS stripped, p_brand || ', ' || p_type AS bare, p_brand || ', ' || p_type AS artists_tidy, "
    "p_brand || ',  ' || p_type AS artists_exact, "
    "chr(9) || p_name || ' by ' || p_brand || ', ' || p_type AS line, "
    "chr(9) || ' ' || chr(9) || p_name || chr(10) || ' by ' || p_brand || ',  ' || p_type AS line_untrimmed, "
    "p_brand || ''', ''' || p_type AS inside, p_name || ' - ' || p_brand AS dashed, "
    "p_name || ' by ' || p_brand AS key_by, p_name || ' - ' || p_brand AS key_dash, p_name AS key_title, "
    "p_brand AS first_artist, CAST(2 AS INTEGER) AS n_artists FROM part",
    "cleaned_documents": f"SELECT doc_id, CAST(length({_CLEAN.format('text')}) AS INTEGER) AS n, "
    f"md5({_CLEAN.format('text')}) AS digest FROM documents",
    "fuzzy_scores": f"WITH {MISSPELT}, prepared AS (SELECT request_id, length(a) AS qn, length(b) AS cn, "
    f"(CAST(1 AS HUGEINT) << length(a)) - 1 AS ones, {_masks('a')} AS masks, {_codes('b')} AS codes FROM "
    f"(SELECT request_id, {_CLEAN.format('title')} AS a, {_CLEAN.format('p_name')} AS b FROM requests "
    f"JOIN part ON p_partkey = request_id)) SELECT request_id, {_RATIO} AS score FROM prepared",
    "ids_from_addresses": "SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/(en|de)/', "
    "'/track/', 'g'), '/track/([^/?]+)', 1), '') AS track_id FROM pages",
    "payload_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
    "coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events",
    "request_matches": f"WITH {TRACKS}, {REQUESTS}, {MATCHES} SELECT r.request_id, m.track_id, CASE WHEN "
    "m.track_id IS NULL THEN 'not_found' ELSE 'local' END AS status FROM requests r LEFT JOIN matches m "
    "ON m.request_id = r.request_id",
    "catalogue_search": f"WITH {TRACKS} SELECT id, name, artists FROM tracks WHERE "
    "contains(lower(name), 'ring') AND contains(lower(artists), 'brand#1')",
    "catalogue_search_regex": f"WITH {TRACKS} SELECT id, name, artists FROM tracks WHERE "
    "regexp_matches(name, '^(old|new) ', 'i') AND regexp_matches(artists, '#1[0-3]''', 'i')",
    "match_menu": f"WITH {TRACKS}, {REQUESTS} SELECT request_id, id AS track_id, name, artists, "
    "row_number() OVER (PARTITION BY request_id ORDER BY id) AS match_no FROM requests JOIN tracks "
    "ON contains(lower(name), lower(title)) AND contains(lower(artists), lower(artist))",
    "match_picks": f"WITH {TRACKS}, {REQUESTS}, menu AS (SELECT request_id, id AS track_id, row_number() "
    "OVER (PARTITION BY request_id ORDER BY id) AS match_no FROM requests JOIN tracks ON "
    "contains(lower(name), lower(title)) AND contains(lower(artists), lower(artist))) SELECT r.request_id, "
    "CAST(2 AS BIGINT) AS match_no, m.track_id, m.track_id IS NOT NULL AS in_range FROM requests r "
    "LEFT JOIN menu m ON m.request_id = r.request_id AND m.match_no = 2",
    "resolved_requests": f"WITH {RESOLVED} SELECT request_id, title, artist, status, track_id, "
    f"{_rs(FEATURES_4)} FROM resolved",
    "fuzzy_matches": f"WITH {MISSPELT}, {MUSIC}, {_fuzzy_on('requests', 'music')} SELECT * FROM matched",
    "fuzzy_matches_by_title": f"WITH {MISSPELT}, {MUSIC}, {_fuzzy_on('requests', 'music', _TITLE_KEY)} "
    "SELECT * FROM matched",
    "fuzzy_matches_weak": "WITH requests AS (SELECT c_custkey AS request_id, c_mktsegment AS title, "
    f"c_name AS artist FROM customer), {MUSIC}, {_fuzzy_on('requests', 'music')} SELECT * FROM matched",
    "scaling_statistics": f"WITH {TRACKS} SELECT "
    + ", ".join(_r(f"avg({f})", f"{f}_mean") + ", " + _r(f"stddev_pop({f})", f"{f}_std") for f in FEATURES_11)
    + " FROM tracks",
    "standardised_features": f"WITH {TRACKS}, {_z(FEATURES_9, 'tracks', 'id', 'scaled')} SELECT id, "
    + ", ".join(_r(f"z{i}", f) for i, f in enumerate(FEATURES_9))
    + ", CAST(0 AS DOUBLE) AS flat FROM scaled",
    "knn_tracks": f"WITH {TRACKS}, {_nearest(FEATURES_4, _self(FEATURES_4), 10, 'euclidean')} "
    f"{_SHOWN}, {_BY_LINE} FROM best",
    "knn_tracks_other": f"WITH {TRACKS}, "
    f"{_nearest(FEATURES_4, _self(FEATURES_4), 10, 'euclidean', skip_self=True)} "
    f"{_SHOWN}, {_BY_LINE} FROM best",
    "cosine_tracks": f"WITH {TRACKS}, {_nearest(FEATURES_4, _self(FEATURES_4), 3, 'cosine', skip_title=True)} "
    f"{_SHOWN}, name || ' by ' || substr(artists, 3, length(artists) - 4) AS line FROM best",
    "knn_one_song": f"WITH {TRACKS}, one AS (SELECT CAST(0 AS BIGINT) AS request_id, '' AS title, "
    f"id AS track_id, {', '.join(FEATURES_4)} FROM tracks ORDER BY id LIMIT 1), "
    f"{_nearest(FEATURES_4, 'one', 10, 'euclidean')} {_SHOWN}, {_BY_LINE} FROM best",
    "first_three": f"WITH {TRACKS}, {_nearest(FEATURES_4, _self(FEATURES_4), 3, 'euclidean')} "
    f"SELECT request_id, rank, track_id, {_r('score', 'score')} FROM best",
    "batch_cosine_top_tracks": f"WITH {TRACKS}, {TOP_TRACKS}, "
    f"{_nearest(FEATURES_9, _top_requests(FEATURES_9), 10, 'cosine')} {_SHOWN} FROM best",
    "batch_knn_top_tracks": f"WITH {TRACKS}, {TOP_TRACKS}, "
    f"{_nearest(FEATURES_4, _top_requests(FEATURES_4), 10, 'euclidean')} {_SHOWN}, {_BY_LINE} FROM best",
    "batch_knn_distinct_songs": f"WITH {TRACKS}, {TOP_TRACKS}, "
    f"{_nearest(FEATURES_4, _top_requests(FEATURES_4), 10, 'euclidean')} SELECT track_id, name, artists, "
    "rank, request_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rank, request_id) "
    "AS nth FROM best) WHERE nth = 1",
    "feature_payload_rows": f"WITH {TRACKS} SELECT CAST(id AS VARCHAR) AS spotify_id, {_rs(FEATURES_11)} "
    "FROM tracks",
    "top_track_rows": f"WITH {TOP_TRACKS} SELECT user_id, pos, CAST(track_id AS VARCHAR) AS track_id, name, "
    "artist FROM top_tracks",
    "search_payload_rows": f"WITH {HITS} SELECT request_id, CAST(track_id AS VARCHAR) AS track_id, "
    "CASE WHEN track_id IS NOT NULL THEN title END AS name, "
    "CASE WHEN track_id IS NOT NULL THEN artist END AS artist FROM hits",
    "id_batches": "SELECT CAST(floor((no - 1) / 40) AS BIGINT) AS batch_no, string_agg(CAST(p_partkey AS "
    "VARCHAR), ',' ORDER BY p_partkey) AS ids, CAST(count(*) AS INTEGER) AS n_ids FROM (SELECT p_partkey, "
    "row_number() OVER (ORDER BY p_partkey) AS no FROM part) GROUP BY 1",
    "top_tracks_report": f"WITH {TRACKS}, {TOP_TRACKS} SELECT user_id, pos, CAST(track_id AS VARCHAR) AS "
    "track_id, (pos + 1) || '. ' || artist || ' - ' || p.name || ' | energy: ' || (round(energy, 1) + CAST(0 AS DOUBLE)) || "
    "', danceability: ' || (round(danceability, 1) + CAST(0 AS DOUBLE)) || ', tempo: ' || (round(tempo, 1) + CAST(0 AS DOUBLE)) AS line "
    "FROM top_tracks p JOIN tracks t ON t.id = p.track_id",
    "paired_by_position": f"WITH {TRACKS}, {LISTENS}, "
    + TOP_TRACK_PARTS.replace("top_tracks AS (", "top_tracks AS MATERIALIZED (")
    + ", records AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS pos, energy "
    "FROM top_tracks p JOIN tracks t ON t.id = p.track_id) "
    "SELECT p.user_id, p.pos, CAST(p.track_id AS VARCHAR) AS track_id, " + _r("CAST(r.energy AS DOUBLE)", "energy")
    + " FROM top_tracks p JOIN records r ON r.user_id = p.user_id AND r.pos = p.pos",
    "item_neighbours": f"WITH {MATRIX}, {NEIGHBOURS} SELECT seed_id, track_id, CAST(rank AS INTEGER) AS rank, "
    f"{_r('score', 'score')} FROM ranked WHERE rank <= 10",
    "collaborative_recommendations": f"WITH {MATRIX}, {METADATA}, {MISSPELT}, {NEIGHBOURS}, "
    f"{_fuzzy_on('requests', 'metadata')} SELECT m.request_id, m.track_id AS seed_id, m.match_score, "
    "m.is_weak_match, CAST(r.rank AS INTEGER) AS rank, CAST(4 - r.rank AS INTEGER) AS display_order, "
    f"r.track_id, d.name, d.artist, {_r('r.score', 'score')}, d.name || ' - ' || d.artist AS line "
    "FROM matched m JOIN ranked r ON r.seed_id = m.track_id AND r.rank <= 3 "
    "JOIN metadata d ON d.track_id = r.track_id",
    "collaborative_top_tracks": f"WITH {MATRIX}, {METADATA}, {NEIGHBOURS}, {TOP_TRACK_PARTS}, "
    "wanted AS (SELECT user_id * 100 + pos AS request_id, name AS title, artist FROM top_tracks), "
    f"{_fuzzy_on('wanted', 'metadata', _TITLE_KEY)} SELECT m.request_id, m.track_id AS seed_id, "
    "CAST(r.rank AS INTEGER) AS rank, CAST(11 - r.rank AS INTEGER) AS display_order, r.track_id, "
    "d.name || ' - ' || d.artist AS line FROM matched m JOIN ranked r ON r.seed_id = m.track_id "
    "AND r.rank <= 10 JOIN metadata d ON d.track_id = r.track_id",
    "ensemble": f"WITH {RESOLVED}, {MATRIX}, {METADATA}, {NEIGHBOURS}, "
    "usable AS (SELECT * FROM resolved WHERE status <> 'not_found'), "
    f"{_nearest(FEATURES_4, 'usable', 3, 'euclidean', 'near_k')}, "
    f"{_nearest(FEATURES_4, 'usable', 3, 'cosine', 'near_c', skip_title=True)}, "
    f"{_fuzzy_on('usable', 'metadata')} "
    "SELECT request_id, 'knn' AS model, rank, CAST(track_id AS VARCHAR) AS track_id, name, "
    f"artists AS artist, {_r('score', 'score')}, name || ' by ' || {_BARE} AS line FROM near_k "
    "UNION ALL SELECT request_id, 'cosine', rank, CAST(track_id AS VARCHAR), name, artists, "
    "round(score, 6) + 0.0, name || ' by ' || substr(artists, 3, length(artists) - 4) FROM near_c "
    "UNION ALL SELECT m.request_id, 'collaborative', CAST(r.rank AS INTEGER), CAST(r.track_id AS VARCHAR), "
    "d.name, d.artist, round(r.score, 6) + 0.0, d.name || ' - ' || d.artist FROM matched m JOIN ranked r "
    "ON r.seed_id = m.track_id AND r.rank <= 3 JOIN metadata d ON d.track_id = r.track_id",
    "play_counts": f"WITH {SCROBBLES} SELECT artist, track, count(*) AS count FROM scrobbles GROUP BY 1, 2",
    "play_counts_numbered": f"WITH {SCROBBLES} SELECT artist, track, count, row_number() OVER (ORDER BY "
    "count DESC, artist, track) AS place FROM (SELECT artist, track, count(*) AS count FROM scrobbles "
    "GROUP BY 1, 2)",
    "top_songs": f"WITH {SCROBBLES} SELECT artist, track, count(*) AS count FROM scrobbles GROUP BY 1, 2 "
    "ORDER BY count DESC, artist, track LIMIT 200",
    "listener_history": f"WITH {HISTORY} SELECT artist, track, count, spotify_id, {_rs(FEATURES_11)} "
    "FROM history",
    "usable_history": f"WITH {HISTORY} SELECT artist, track, count, spotify_id FROM heard",
    "weighted_features": f"WITH {HISTORY} SELECT artist, track, "
    + ", ".join(_r(f"CAST({f} AS DOUBLE) * count", f) for f in FEATURES_11)
    + " FROM heard",
    "taste_profile": f"WITH {HISTORY} SELECT "
    + ", ".join(_r(f"sum(CAST({f} AS DOUBLE) * count) / sum(count)", f) for f in FEATURES_11)
    + " FROM heard",
    "unheard_candidates": f"WITH {HISTORY} SELECT id, artist, track FROM unheard",
    "unheard_candidates_all_history": f"WITH {HISTORY} SELECT id, artist, track FROM songs s WHERE NOT "
    "EXISTS (SELECT 1 FROM history h WHERE h.artist = s.artist AND h.track = s.track)",
    "training_rows": f"WITH {HISTORY} SELECT CAST(NULL AS BIGINT) AS id, artist, track, count FROM heard "
    "UNION ALL SELECT id, artist, track, 0 FROM (SELECT *, row_number() OVER (ORDER BY "
    f"{_hash(7, 'id')}, id) AS nth FROM unheard) WHERE nth <= (SELECT count(*) FROM heard)",
    "forest_recommendations": f"WITH RECURSIVE {HISTORY}, {_TRAINING}, train AS MATERIALIZED (SELECT 1 AS run, * FROM training), "
    "asked AS MATERIALIZED (SELECT 1 AS run, -1 - row_number() OVER (ORDER BY id) AS row_no, * FROM unheard), "
    + _grown("train", "asked", 200)
    + "SELECT id, artist, track, " + _r("predicted_count", "predicted_count")
    + " FROM predicted JOIN asked USING (run, row_no) ORDER BY round(predicted_count, 9) DESC, id LIMIT 20",
    "forest_splits": f"WITH RECURSIVE {HISTORY}, {_TRAINING}, train AS MATERIALIZED (SELECT 1 AS run, * FROM training), "
    "asked AS (SELECT * FROM train WHERE false), " + _grown("train", "asked", 1, 4)
    + """, lines AS (
            SELECT node, feature, value, lead(value) OVER line AS above, sum(w) OVER line AS l, sum(wy) OVER line AS ly,
                   sum(w) OVER whole AS n, sum(wy) OVER whole AS total
            FROM (SELECT node, feature, value, sum(w) AS w, sum(w * label) AS wy FROM steps JOIN cells USING (run, row_no)
                  WHERE w > 0 AND node < 16 GROUP BY ALL)
            WINDOW line AS (PARTITION BY node, feature ORDER BY value), whole AS (PARTITION BY node, feature)
        ),
        cuts AS (
            SELECT node, feature, (value + above) / 2 AS threshold FROM lines
            WHERE above IS NOT NULL AND node IN (SELECT node // 2 FROM leaves)
            QUALIFY row_number() OVER (PARTITION BY node
                ORDER BY ly * ly / l + (total - ly) * (total - ly) / (n - l) DESC, feature, value) = 1
        )
        SELECT node, feature, """ + _r("threshold", "threshold") + ", " + _r("value", "value")
    + ", n FROM leaves LEFT JOIN cuts USING (node)",
    "forest_evaluation": f"WITH RECURSIVE {_evaluated(50, True)} SELECT " + _r("avg(mse)", "mse") + ", " + _r("sqrt(avg(mse))", "rmse")
    + " FROM errors",
    "forest_without_negatives": f"WITH RECURSIVE {_evaluated(1, False)} SELECT run::INTEGER AS run, (run - 1)::INTEGER AS seed, "
    + _r("mse", "mse") + " FROM runs LEFT JOIN errors USING (run)",
    "forest_of_one_song": f"WITH {HISTORY} SELECT id, artist, track, (SELECT count FROM heard ORDER BY "
    "md5('42|' || artist || '|' || track), artist, track LIMIT 1)::DOUBLE AS predicted_count "
    "FROM unheard WHERE EXISTS (SELECT 1 FROM heard) ORDER BY id LIMIT 20",
    "sampled_tracks": f"WITH {MUSIC} SELECT * FROM music ORDER BY {_hash(42, 'track_id')}, track_id LIMIT 150",
    "split_tracks": f"WITH {MUSIC} SELECT *, row_number() OVER (ORDER BY {_hash(64, 'track_id')}, track_id) "
    "<= ceil(0.2 * count(*) OVER ()) AS is_test FROM music",
    "prediction_error": f"WITH {SCROBBLES}, counts AS (SELECT artist, track, count(*) AS count FROM scrobbles "
    "GROUP BY 1, 2), errors AS (SELECT avg((count - mean) * (count - mean)) AS mse FROM counts JOIN "
    "(SELECT artist, avg(count) AS mean FROM counts GROUP BY 1) USING (artist)) SELECT "
    f"{_r('mse', 'mse')}, {_r('sqrt(mse)', 'rmse')} FROM errors",
    "total_inertia": f"WITH {TRACKS}, {_z(FEATURES_4, 'tracks', 'id', 'scaled')} SELECT CAST(1 AS INTEGER) "
    "AS k, " + _r("sum(z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3)", "inertia") + " FROM scaled",
    "track_clusters": f"WITH RECURSIVE {_lloyd('SELECT 5 AS k')}, best AS (SELECT k, restart FROM fitted ORDER BY round(inertia, 6), restart LIMIT 1) "
    "SELECT p.id, name, CAST(arg_min(c.cluster, (" + " + ".join(f"(p.z{i} - c.z{i}) * (p.z{i} - c.z{i})" for i in range(4))
    + ", c.cluster)) - 1 AS INTEGER) AS cluster FROM scaled p JOIN tracks t ON t.id = p.id, finals c JOIN best USING (k, restart) GROUP BY p.id, name",
    "elbow": f"WITH RECURSIVE {_lloyd('SELECT unnest(range(1, 20))::INTEGER AS k')} SELECT k, " + _r("arg_min(inertia, (round(inertia, 6), restart))", "inertia")
    + " FROM fitted GROUP BY k",
    "projection_2d": _flat(),
    "sampled_fraction": f"WITH {LISTENS} SELECT user_id, track_id, playcount FROM (SELECT user_id, track_id, playcount, "
    "md5('64|' || row_number() OVER (PARTITION BY user_id, track_id, playcount) || '|{\"user_id\":' || user_id "
    "|| ',\"track_id\":' || track_id || ',\"playcount\":' || playcount || '}') AS drawn FROM listens) "
    "WHERE ('0x' || substr(drawn, 1, 13))::BIGINT / 4503599627370496 < 0.1::DOUBLE",
}

ORACLE |= {
    "catalogue_csv": ORACLE["catalogue_scan"],
    "music_csv": f"WITH {MUSIC} SELECT * FROM music",
    "listens_csv": f"WITH {LISTENS} SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, sum(playcount)::BIGINT AS plays "
    "FROM listens GROUP BY 1",
    "scrobbles_csv": ORACLE["play_counts"],
    "track_metadata_landed": ORACLE["track_metadata"],
    "interactions_landed": ORACLE["interaction_matrix"],
    "listeners_per_track_bucketed": "WITH rows AS ("
    + ORACLE["interaction_matrix"]
    + ") SELECT track_id, count(*) AS listeners, sum(reach)::BIGINT AS reached "
    "FROM (SELECT track_id, count(*) OVER (PARTITION BY user_id) AS reach FROM rows) GROUP BY track_id",
    "history_csv": ORACLE["listener_history"],
    "recommendations_landed": "SELECT request_id, 'cosine' AS model, rank, track_id, name, artists AS artist, score, line FROM ("
    + ORACLE["cosine_tracks"] + ")",
    "staged_search_rows": "SELECT * FROM (" + ORACLE["search_payload_rows"] + ") WHERE request_id % 7 <> 0",
    "staged_search_malformed": f"WITH {REQUESTS} SELECT request_id, 9 AS n_chars FROM requests WHERE request_id % 7 = 0",
}
