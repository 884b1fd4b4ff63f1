"""The queries on scan lines, regions and resampled rasters in DuckDB's SQL, with formulas and constants of its own."""

from __future__ import annotations

from rasterflow.oracle import COLOUR, PROBLEMS, STAGES, TYPE, correlation, deviation, engine_quality, joined, mean, share, tiled, variance


def _mirror(k: str, n: str) -> str:
    return f"(CASE WHEN {n} = 1 THEN 0 WHEN {k} < 0 THEN -({k}) WHEN {k} > {n} - 1 THEN 2 * ({n} - 1) - ({k}) ELSE {k} END)"


_LEVEL = "px[(i // 24 % 24) * 24 + i % 24 + 1] // 8 + CASE WHEN 16 * (i // 24) > 8 * height + (i % 24) * (photo_id % 7 - 3) THEN 150 ELSE 40 END"
_SPOT = "(i % 24 >= photo_id * 5 % 20 AND i % 24 < photo_id * 5 % 20 + 2 + photo_id % 3 AND i // 24 >= photo_id * 3 % 18 AND i // 24 < photo_id * 3 % 18 + 2 + photo_id % 3)"
SCENES = (
    f"{tiled(3)}, scenes AS MATERIALIZED (SELECT photo_id, height, 24 AS width, [CASE WHEN {_SPOT} OR (i % 24 = photo_id * 11 % 24 AND i // 24 = height - 2) THEN 255 ELSE ({_LEVEL})::INTEGER END FOR i IN range(height * 24)] AS px "
    "FROM (SELECT photo_id, px, (24 + photo_id % 3 * 8)::INTEGER AS height FROM tiled))"
)


def _at(px: str, dy: int, dx: int) -> str:
    return f"{px}[{_mirror(f'(i // width + {dy})', 'height')} * width + {_mirror(f'(i % width + {dx})', 'width')} + 1]"


_GX = " + ".join(f"{k} * ({_at('px', dy, 1)} - {_at('px', dy, -1)})" for dy, k in ((-1, 1), (0, 2), (1, 1)))
_GY = " + ".join(f"{k} * ({_at('px', 1, dx)} - {_at('px', -1, dx)})" for dx, k in ((-1, 1), (0, 2), (1, 1)))
_M = "(abs(gx[{0} + 1]) + abs(gy[{0} + 1]))"


def _m(dy: str, dx: str) -> str:
    """Strength beside place i, 0 beyond the border."""
    return f"(CASE WHEN i // width + ({dy}) BETWEEN 0 AND height - 1 AND i % width + ({dx}) BETWEEN 0 AND width - 1 THEN m[(i // width + ({dy})) * width + i % width + ({dx}) + 1] ELSE 0 END)"


_SIDE = "(CASE WHEN (gx[i + 1] < 0) <> (gy[i + 1] < 0) THEN -1 ELSE 1 END)"
_TOP = (
    "CASE WHEN abs(gy[i + 1])::BIGINT * 32768 < abs(gx[i + 1])::BIGINT * 13573 THEN m[i + 1] > " + _m("0", "-1") + " AND m[i + 1] >= " + _m("0", "1")
    + " WHEN abs(gy[i + 1])::BIGINT * 32768 > abs(gx[i + 1])::BIGINT * 79109 THEN m[i + 1] > " + _m("-1", "0") + " AND m[i + 1] >= " + _m("1", "0")
    + f" ELSE m[i + 1] > {_m('-1', '-' + _SIDE)} AND m[i + 1] > {_m('1', _SIDE)} END"
)


def edges(low: int, high: int, name: str = "edge", first: bool = True) -> str:
    """``edge`` (or name): the pixels that a way over weak ones joins to a strong one."""
    ground = (
        f"{SCENES}, graded AS (SELECT *, [{_GX} FOR i IN range(height * width)] AS gx, [{_GY} FOR i IN range(height * width)] AS gy FROM scenes)"
        f", strong AS (SELECT *, [{_M.format('i')} FOR i IN range(height * width)] AS m FROM graded)"
        f", peaks AS MATERIALIZED (SELECT photo_id, i // width AS y, i % width AS x, s FROM (SELECT photo_id, width, i, m[i + 1] AS s, {_TOP} AS top FROM (SELECT *, unnest(range(height * width)) AS i FROM strong)) WHERE top), "
    )
    return (ground if first else "") + (
        f"{name} AS (SELECT photo_id, y, x FROM peaks WHERE s > {high} UNION SELECT w.photo_id, w.y, w.x FROM {name} e JOIN peaks w ON w.photo_id = e.photo_id AND w.s > {low} AND w.y BETWEEN e.y - 1 AND e.y + 1 AND w.x BETWEEN e.x - 1 AND e.x + 1)"
    )


def _band(name: str, test: str) -> str:
    q = f"[px[i + 1] FOR i IN range(height * width) IF {test}]"
    return f"{q} AS {name}_px, (SELECT count(*) FROM edge e WHERE e.photo_id = s.photo_id AND {test.replace('i // width', 'e.y')}) AS {name}_edges"


_DENSITY = "(CASE WHEN len({0}_px) > 0 THEN {0}_edges / len({0}_px)::DOUBLE * 100 ELSE 0 END)"
_STD = "(CASE WHEN len({0}_px) > 0 THEN " + deviation("{0}_px") + " ELSE 0 END)"
_MEAN = "(CASE WHEN len({0}_px) > 0 THEN " + mean("{0}_px") + " ELSE " + mean("every_px") + " END)"
_SOCIAL = (
    f"least(100, greatest(0, {_DENSITY.format('top')} * 1.8 + {_DENSITY.format('bottom')} * 1.5 + greatest(0, 20 - {_STD.format('top')}) * 0.35 + greatest(0, 20 - {_STD.format('bottom')}) * 0.55 "
    f"+ least(abs({_MEAN.format('top')} - {_MEAN.format('middle')}) + abs({_MEAN.format('bottom')} - {_MEAN.format('middle')}), 80) / 4 + CASE WHEN height / width::DOUBLE > 1.5 THEN 16 ELSE 0 END))"
)
_PARTS = {"every": "i // width >= 0", "top": "i // width < greatest(30, floor(height * 0.12))", "middle": "i // width >= greatest(30, floor(height * 0.12)) AND i // width < floor(height * 0.8)", "bottom": "i // width >= floor(height * 0.8)"}
_SCREENS = (
    f"parts AS (SELECT s.*, {', '.join(_band(name, test) for name, test in _PARTS.items())} FROM scenes s), scored AS (SELECT photo_id, height, width, round({_DENSITY.format('every')}, 6) AS text_edge, round({_SOCIAL}, 6) AS social FROM parts)"
    ", screens AS MATERIALIZED (SELECT *, social >= 34 OR (height / width::DOUBLE > 1.5 AND social >= 26) OR (height / width::DOUBLE > 1.75 AND social >= 22 AND text_edge >= 1) AS is_screenshot FROM scored)"
)
_SEGMENTS = (
    "turns AS (SELECT t, round(65536 * cos(radians(t)))::BIGINT AS c, round(65536 * sin(radians(t)))::BIGINT AS s FROM (SELECT unnest(range(-12, 13)) AS t))"
    ", cast_votes AS MATERIALIZED (SELECT photo_id, y, x, t, (y * c - x * s + 32768) >> 16 AS rho FROM edge, turns)"
    ", counted AS (SELECT *, count(*) OVER (PARTITION BY photo_id, t, rho) AS votes FROM cast_votes)"
    ", chosen AS (SELECT * FROM counted WHERE votes >= 9 QUALIFY row_number() OVER (PARTITION BY photo_id, y, x ORDER BY votes DESC, abs(t), t) = 1)"
    ", starts AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY photo_id, t, rho ORDER BY x, y) <= 4 THEN 0 ELSE 1 END AS new FROM chosen)"
    ", parted AS (SELECT *, sum(new) OVER (PARTITION BY photo_id, t, rho ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS part FROM starts)"
    ", ends AS (SELECT photo_id, min({'x': x, 'y': y}) AS a, max({'x': x, 'y': y}) AS b FROM parted GROUP BY photo_id, t, rho, part)"
    ", segments AS MATERIALIZED (SELECT photo_id, degrees(atan2((b.y - a.y)::DOUBLE, (b.x - a.x)::DOUBLE)) AS angle, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ends WHERE b.x - a.x >= 8 OR abs(b.y - a.y) >= 8)"
)


def _regions(mask: str, least: str, most: str) -> str:
    """Regions of the pixels of ``mask`` by reachability."""
    return (
        f"{mask}, reach AS (SELECT photo_id, y, x, y AS ty, x AS tx FROM mask UNION SELECT r.photo_id, m.y, m.x, r.ty, r.tx FROM reach r JOIN mask m ON m.photo_id = r.photo_id AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1)"
        ", named AS (SELECT photo_id, y, x, min({'y': ty, 'x': tx}) AS region FROM reach GROUP BY 1, 2, 3)"
        ", areas AS (SELECT photo_id, region, count(*) AS area, min(y) AS top, min(x) AS \"left\", max(y) AS bottom, max(x) AS \"right\" FROM named GROUP BY 1, 2)"
        f" SELECT photo_id, area, top, \"left\", bottom, \"right\" FROM areas JOIN scenes USING (photo_id) WHERE area >= {least} AND area <= {most}"
    )


_BRIGHT = f"{SCENES}, mask AS MATERIALIZED (SELECT photo_id, i // width AS y, i % width AS x FROM (SELECT *, unnest(range(height * width)) AS i FROM scenes) WHERE px[i + 1] > 232)"
_NINE = " AND ".join(
    f"(i // width + {dy} NOT BETWEEN 0 AND height - 1 OR i % width + {dx} NOT BETWEEN 0 AND width - 1 OR px[(i // width + {dy}) * width + i % width + {dx} + 1] > 232)" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
)
_OPENED = (
    f"{SCENES}, cores AS (SELECT photo_id, height, width, i // width AS cy, i % width AS cx FROM (SELECT *, unnest(range(height * width)) AS i FROM scenes) WHERE {_NINE})"
    ", mask AS MATERIALIZED (SELECT DISTINCT photo_id, y, x FROM (SELECT *, cy + dy AS y, cx + dx AS x FROM cores, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1)"
)
_MEDIAN = "list_sort([" + ", ".join(_at("px", dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + "])[5]"
_OFF = f"{SCENES}, offs AS (SELECT photo_id, height, width, [abs(px[i + 1] - {_MEDIAN}) > 28 FOR i IN range(height * width)] AS o FROM scenes)"
_SQUARE = lambda y, x: f"({y} >= 0 AND {x} >= 0 AND {y} < height - 1 AND {x} < width - 1 AND o[({y}) * width + {x} + 1] AND o[({y}) * width + {x} + 2] AND o[({y} + 1) * width + {x} + 1] AND o[({y} + 1) * width + {x} + 2])"
_COVERED = " OR ".join(_SQUARE(f"(i // width - {dy})", f"(i % width - {dx})") for dy in (0, 1) for dx in (0, 1))


def area(px: str, h: str, w: str, m: str, n: str) -> str:
    """A raster by area: every source pixel's overlap with every place."""

    def mixed(i: str, size: str, out: str, j: str, value: str) -> str:
        return f"list_sum([(least(({j} + 1) * ({out}), ({i} + 1) * ({size})) - greatest({j} * ({out}), {i} * ({size}))) * {value} FOR {j} IN range(({i} * ({size})) // ({out}), (({i} + 1) * ({size}) - 1) // ({out}) + 1)])"

    tall = f"[[{mixed('i', h, m, 'j', f'{px}[j * ({w}) + x + 1]')} FOR x IN range({w})] FOR i IN range({m})]"
    return f"flatten([[((2 * {mixed('k', w, n, 'e', 'line[e + 1]')} + ({h}) * ({w})) // (2 * ({h}) * ({w})))::INTEGER FOR k IN range({n})] FOR line IN {tall}])"


_SMALL = f"{SCENES}, sides AS (SELECT *, greatest(1, round_even(height * least(1, 20 / greatest(height, width)::DOUBLE), 0))::INTEGER AS m, greatest(1, round_even(width * least(1, 20 / greatest(height, width)::DOUBLE), 0))::INTEGER AS n FROM scenes), shrunk AS (SELECT photo_id, m AS height, n AS width, {area('px', 'height', 'width', 'm', 'n')} AS px FROM sides)"
_LAPLACE = f"[{_at('px', -1, 0)} + {_at('px', 1, 0)} + {_at('px', 0, -1)} + {_at('px', 0, 1)} - 4 * px[i + 1] FOR i IN range(height * width)]"
_SMOOTH = "(" + " + ".join(f"{(1 + (dy == 0)) * (1 + (dx == 0))} * {_at('px', dy, dx)}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + " + 8) >> 4"
_RESIDUAL = f"[px[i + 1] - ({_SMOOTH}) FOR i IN range(height * width)]"
_DCT = "[[(1048576 * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 16::DOUBLE) * cos(pi() * (2 * x + 1) * k / 32)) FOR x IN range(16)] FOR k IN range(8)]"
_CROP = "flatten([px[r * 24 + photo_id % 5 + 1:r * 24 + photo_id % 5 + 6 + photo_id % 9] FOR r IN range(photo_id % 3, photo_id % 3 + {0})])"
_STEPS = {
    True: ("[abs(px[k + 1 + width] - px[k + 1]) FOR k IN range((height - 1) * width)]", "[abs(px[k + 1 + width] - px[k + 1]) FOR k IN range((height - 1) * width) IF (k // width) % 8 = 7]"),
    False: ("[abs(px[k // (width - 1) * width + k % (width - 1) + 2] - px[k // (width - 1) * width + k % (width - 1) + 1]) FOR k IN range(height * (width - 1))]", "[abs(px[k // (width - 1) * width + k % (width - 1) + 2] - px[k // (width - 1) * width + k % (width - 1) + 1]) FOR k IN range(height * (width - 1)) IF k % (width - 1) % 8 = 7]"),
}
_BLOCKS = "least(100, greatest(0, ((" + " + ".join(f"{mean(part)} / ({mean(every)} + 1e-6)" for every, part in _STEPS.values()) + ") / 2 - 0.88) * 120))"
_INSPECTED = (
    f"{edges(70, 150)}, {_SCREENS}, planes AS (SELECT photo_id, px, {_LAPLACE} AS lap, {_RESIDUAL} AS res, {_BLOCKS} AS compression_axes FROM scenes)"
    f", metrics AS (SELECT photo_id, compression_axes, {variance('lap')} AS blur, {deviation('res')} AS noise, {deviation('px')} AS contrast, {share('px', 'q < 35')} AS dark_35, {share('px', 'q <= 8')} AS dark_8, {share('px', 'q > 248')} AS light_248, {share('px', 'q >= 250')} AS clipped_250 FROM planes)"
    ", inspected AS (SELECT *, least(height, width) < 1000 OR height::BIGINT * width < 1500000 AS is_low_resolution, false AS is_monochrome, 0 AS face_count, 0.0 AS smallest_face FROM screens JOIN metrics USING (photo_id))"
)


#: What each file of a model comes to: whether it is taken, then layout, tile size, blend and whether the size is kept.
_FILES = {
    "side": (11, ["1,auto,512,1,0", "0", "0", "0", "1,auto,300,1,0", "1,auto,256,0.5,0", "1,auto,256,1,1", "1,auto,64,1,0", "1,5,70,1,0", "0", "0"]),
    "plain": (4, ["1,auto,200,1,0", "0", "0", "0"]),
    "near": (3, ["0", "0", "1,auto,256,1,0"]),
    "far": (2, ["1,nhwc,400,1,0", "0"]),
}
_PICKED = "coalesce(" + ", ".join(f"CASE WHEN [{', '.join(repr(x) for x in rows)}][event_id % {n} + 1] <> '0' THEN [{', '.join(repr(x) for x in rows)}][event_id % {n} + 1] END" for n, rows in _FILES.values()) + ", '1,auto,256,1,0')"
_CODED = "CASE kind WHEN 'minus_one_one' THEN v / 127.5::DOUBLE - 1 WHEN 'zero_255' THEN v::DOUBLE ELSE v / 255::DOUBLE END"
_DECODED = "floor(greatest(0, least(255, CASE kind WHEN 'minus_one_one' THEN (({c}) + 1) * 127.5::DOUBLE WHEN 'zero_255' THEN {c} ELSE ({c}) * 255::DOUBLE END)))::INTEGER"
_TENSORS = (
    f"{COLOUR}, named AS (SELECT *, CASE WHEN photo_id % 2 = 0 THEN 'nchw' ELSE 'nhwc' END AS layout, CASE WHEN photo_id % 3 = 0 THEN 'bgr' ELSE 'rgb' END AS \"order\", {{ranges}}[(photo_id // 2) % 3 + 1] AS kind FROM colour)"
    ", sides AS (SELECT *, CASE WHEN \"order\" = 'bgr' THEN [b, g, r] ELSE [r, g, b] END AS three FROM named)"
    ", cells AS (SELECT photo_id, layout, \"order\", kind, c, p, CASE WHEN layout = 'nchw' THEN (c - 1) * 64 + p - 1 ELSE (p - 1) * 3 + c - 1 END AS i, three[c][p] AS v FROM sides, (SELECT unnest([1, 2, 3]) AS c), (SELECT unnest(range(1, 65)) AS p))"
    f", coded AS (SELECT *, {_CODED} AS t FROM cells)"
    f", back AS (SELECT *, CASE WHEN photo_id % 5 = 0 AND i IN (7, 150) THEN 0 WHEN photo_id % 5 = 0 AND i = 100 THEN 255 ELSE {_DECODED.format(c='t')} END AS u, CASE WHEN c = 2 THEN 'g' WHEN (c = 1) = (\"order\" = 'bgr') THEN 'b' ELSE 'r' END AS plane FROM coded)"
)


def _ramp(place: str, size: str, overlap: int) -> str:
    edge = f"least({overlap}, greatest(1, {size} // 2))"
    rise = lambda k: f"CASE WHEN {edge} = 1 THEN 0.08::DOUBLE ELSE 0.08::DOUBLE + 0.92::DOUBLE * ({k}) / greatest({edge} - 1, 1) END"
    return f"(CASE WHEN {place} >= {size} - {edge} THEN {rise(f'{size} - 1 - {place}')} WHEN {place} < {edge} THEN {rise(place)} ELSE 1.0::DOUBLE END)"


_DOUBLED = (
    f"{SCENES}, ys AS (SELECT *, unnest(range(0, height, 8)) AS y FROM scenes), xs AS (SELECT *, unnest(range(0, width, 8)) AS x FROM ys), t AS (SELECT *, 2 * (least(y + 12, height) - y) AS h, 2 * (least(x + 12, width) - x) AS w FROM xs), "
    f"c AS (SELECT *, unnest(range(h * w)) AS k FROM t), p AS (SELECT photo_id, 2 * y + k // w AS oy, 2 * x + k % w AS ox, px[(y + k // w // 2) * width + x + k % w // 2 + 1] + (y + x) % 16 AS v, {_ramp('(k // w)', 'h', 8)} * {_ramp('(k % w)', 'w', 8)} AS wt FROM c), "
    "s AS (SELECT photo_id, oy, ox, floor(round(least(255.0::DOUBLE, sum(v * wt) / sum(wt)), 6))::INTEGER AS ramped, floor(round(least(255.0::DOUBLE, avg(v)), 6))::INTEGER AS even FROM p GROUP BY 1, 2, 3)"
)


def oracle_sql() -> dict[str, str]:
    return {
        "spec_types": f"SELECT event_id, p[2] AS layout, p[3]::BIGINT AS tile_size, p[4]::DOUBLE AS blend_strength, p[5] = '1' AS preserve_size FROM (SELECT event_id, string_split({_PICKED}, ',') AS p FROM events)",
        "layouts": f"WITH {_TENSORS.replace('{ranges}', repr(['zero_one', 'minus_one_one', 'zero_255']))} SELECT photo_id, layout, \"order\", kind, round(sum(t * (i + 1) ORDER BY i) / 1000, 3) AS place_sum, sum(CASE WHEN plane = 'b' THEN u ELSE 0 END)::BIGINT AS b_sum, sum(CASE WHEN plane = 'g' THEN u ELSE 0 END)::BIGINT AS g_sum, sum(CASE WHEN plane = 'r' THEN u ELSE 0 END)::BIGINT AS r_sum, count_if(abs(u - v) > 1)::BIGINT AS changed FROM back GROUP BY ALL",
        "edge_map": f"WITH RECURSIVE {edges(70, 150)} SELECT photo_id, y, string_agg(x::VARCHAR, ',' ORDER BY x) AS xs FROM edge GROUP BY 1, 2",
        "screen_ui": f"WITH RECURSIVE {edges(70, 150)}, {_SCREENS} SELECT photo_id, text_edge, social, is_screenshot FROM screens",
        "horizon_segments": f"WITH RECURSIVE {edges(60, 160)}, {_SEGMENTS} SELECT photo_id, round(angle, 6) AS angle, x1, y1, x2, y2 FROM segments",
        "horizon_plan": f"WITH RECURSIVE {edges(60, 160)}, {_SEGMENTS}, angles AS (SELECT photo_id, round(median(angle), 6) AS angle FROM segments WHERE abs(angle) <= 12 GROUP BY 1), {edges(70, 150, 'hard', False)}, {_HARD_SCREENS} "
        "SELECT photo_id, coalesce(angle, 0.0) AS angle, abs(coalesce(angle, 0.0)) >= 0.45 AND abs(coalesce(angle, 0.0)) <= 8 AND NOT is_screenshot AS straightens FROM screens LEFT JOIN angles USING (photo_id)",
        "scene_inspection": f"WITH RECURSIVE {_INSPECTED}, q AS (SELECT *, round_even({engine_quality('blur', 'contrast', 'noise', 'dark_8', 'clipped_250')}, 0)::INTEGER AS quality_score FROM inspected) SELECT photo_id, is_screenshot, {joined(PROBLEMS, '; ')} AS problems, {TYPE} AS image_type, {joined(STAGES, '; ')} AS stages FROM q",
        "tiled_upscale": f"WITH {_DOUBLED} SELECT photo_id, count(*) AS pixels, sum(ramped)::BIGINT AS ramped_sum, sum(even)::BIGINT AS even_sum, sum(ramped * (oy * 7 + ox))::BIGINT AS ramped_place_sum, count(*) FILTER (ramped <> even) AS differing FROM s GROUP BY 1",
        "spot_regions": "WITH RECURSIVE " + _regions(_BRIGHT, "2", "height * width / 100"),
        "flare_regions": "WITH RECURSIVE " + _regions(_OPENED, "9", "1000"),
        "dust_share": f"WITH {_OFF}, d AS (SELECT photo_id, len([i FOR i IN range(height * width) IF {_COVERED}]) / (height * width)::DOUBLE AS share FROM offs) SELECT photo_id, round(share, 6) AS share, share > 0 AND share < 0.012 AS mended FROM d",
        "preview_focus": f"WITH {_SMALL}, p AS (SELECT *, {_LAPLACE} AS lap, {_RESIDUAL} AS res FROM shrunk) SELECT photo_id, height AS rows, width AS columns, list_sum(px)::BIGINT AS level_sum, round({variance('lap')}, 4) AS blur, round({deviation('res')}, 6) AS noise FROM p",
        "patch_similarity": f"WITH {tiled(3)}, mixed AS (SELECT t.photo_id, t.px AS one, [(3 * t.px[i] + coalesce(n.px, t.px)[i]) // 4 FOR i IN range(1, 577)] AS other FROM tiled t LEFT JOIN tiled n ON n.photo_id = t.photo_id + 1), "
        f"crops AS (SELECT photo_id, (7 + photo_id % 7)::INTEGER AS h, (7 + photo_id % 7 - CASE WHEN photo_id % 10 = 0 THEN 1 ELSE 0 END)::INTEGER AS oh, (6 + photo_id % 9)::INTEGER AS w, {_CROP.format('7 + photo_id % 7').replace('px[', 'one[')} AS one, "
        f"{_CROP.format('7 + photo_id % 7 - CASE WHEN photo_id % 10 = 0 THEN 1 ELSE 0 END').replace('px[', 'other[')} AS other FROM mixed), "
        f"a AS (SELECT photo_id, h = oh AS same, {area('one', 'h', 'w', '96', '96')} AS p1, {area('other', 'oh', 'w', '96', '96')} AS p2 FROM crops) "
        f"SELECT photo_id, len(p1) AS pixels, round({correlation('p1', 'p2', True)}, 6) AS strict, round(CASE WHEN same THEN {correlation('p1', 'p2', False)} ELSE 0 END, 6) AS lenient FROM a",
        "perceptual_hashes": f"WITH {tiled(3)}, waves AS (SELECT [[round(v)::BIGINT FOR v IN l] FOR l IN {_DCT}] AS b), small AS (SELECT photo_id, {area('px', '24', '24', '16', '16')} AS g FROM tiled), "
        "tall AS (SELECT photo_id, b, [[list_sum([line[y + 1] * g[y * 16 + x + 1] FOR y IN range(16)])::BIGINT FOR x IN range(16)] FOR line IN b] AS t FROM small, waves), "
        "low AS (SELECT photo_id, flatten([[list_sum([wave[x] * line[x] FOR x IN range(1, 17)])::BIGINT FOR wave IN b] FOR line IN t]) AS c FROM tall), "
        "mid AS (SELECT *, list_sort(c[9:64]) AS o FROM low), bits AS (SELECT photo_id, array_to_string([CASE WHEN 2 * v > o[28] + o[29] THEN '1' ELSE '0' END FOR v IN c], '') AS s FROM mid) "
        "SELECT photo_id, array_to_string([lower(substr('0123456789ABCDEF', ((substr(s, 4 * k + 1, 1) = '1')::INTEGER * 8 + (substr(s, 4 * k + 2, 1) = '1')::INTEGER * 4 + (substr(s, 4 * k + 3, 1) = '1')::INTEGER * 2 + (substr(s, 4 * k + 4, 1) = '1')::INTEGER) + 1, 1)) FOR k IN range(16)], '') AS phash FROM bits",
    }


#: Screens by the other thresholds need an edge map of their own.
_HARD_SCREENS = _SCREENS.replace("edge e", "hard e")
