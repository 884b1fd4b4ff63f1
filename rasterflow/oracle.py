"""The registered queries in DuckDB's SQL. Expressions are put together from the same definitions, written anew."""

from __future__ import annotations

from rasterflow.operators import candidates, packs, rules
from rasterflow.sources.rasters import SHAPES

_GAIN = "CASE vec_id % 6 " + " ".join(f"WHEN {k} THEN {g}::DOUBLE" for k, (g, _) in enumerate(SHAPES)) + " END"
_OFFSET = "CASE vec_id % 6 " + " ".join(f"WHEN {k} THEN {o}::DOUBLE" for k, (_, o) in enumerate(SHAPES)) + " END"
_BASE = "least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((v::DOUBLE + 0.5::DOUBLE) * 255.0::DOUBLE)))"
SMALL = f"small AS (SELECT vec_id AS photo_id, label, [least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor({_BASE} * gain + off)))::INTEGER FOR v IN embedding] AS px FROM (SELECT *, {_GAIN} AS gain, {_OFFSET} AS off FROM embeddings))"
PLAIN = f"plain AS (SELECT vec_id AS photo_id, [{_BASE}::INTEGER FOR v IN embedding] AS px FROM embeddings)"


def tiled(side: int) -> str:
    n, edge = side * side, 8 * side
    place = f"tiles[((i // {edge}) // 8 * {side} + (i % {edge}) // 8) % len(tiles) + 1][(i // {edge}) % 8 * 8 + (i % {edge}) % 8 + 1]"
    return f"{PLAIN}, tiled AS (SELECT photo_id, [{place} FOR i IN range({edge * edge})] AS px FROM (SELECT photo_id // {n} AS photo_id, list(px ORDER BY photo_id) AS tiles FROM plain GROUP BY 1))"


COLOUR = (
    PLAIN
    + ", three AS (SELECT photo_id // 3 AS photo_id, max(CASE WHEN photo_id % 3 = 0 THEN px END) AS b, max(CASE WHEN photo_id % 3 = 1 THEN px END) AS g, max(CASE WHEN photo_id % 3 = 2 THEN px END) AS r FROM plain GROUP BY 1)"
    + ", filled AS (SELECT photo_id, coalesce(b, g, r) AS b, coalesce(g, b, r) AS g, coalesce(r, g, b) AS r FROM three)"
    + ", colour AS (SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN [(b[i] + 15 * g[i]) // 16 FOR i IN range(1, 65)] ELSE b END AS b, g, CASE WHEN photo_id % 3 = 0 THEN [(r[i] + 15 * g[i]) // 16 FOR i IN range(1, 65)] ELSE r END AS r FROM filled)"
)


def mean(px: str) -> str:
    return f"(list_sum({px})::DOUBLE / len({px}))"


def variance(px: str) -> str:
    return f"((len({px}) * list_sum([q::BIGINT * q FOR q IN {px}]) - list_sum({px}) * list_sum({px}))::DOUBLE / (len({px}) * len({px}))::DOUBLE)"


def deviation(px: str) -> str:
    return f"sqrt({variance(px)})"


def share(px: str, test: str) -> str:
    return f"(len([q FOR q IN {px} IF {test}])::DOUBLE / len({px}))"


def percentile(px: str, p: float) -> str:
    return f"list_aggregate([q::DOUBLE FOR q IN {px}], 'quantile_cont', {p})"


def at(px: str, dy: int, dx: int, h: str = "8", w: str = "8", i: str = "i") -> str:
    def mirror(k: str, n: str) -> str:
        return f"(CASE WHEN {k} < 0 THEN -({k}) WHEN {k} > {n} - 1 THEN 2 * ({n} - 1) - ({k}) ELSE {k} END)"

    return f"{px}[{mirror(f'({i} // {w} + {dy})', h)} * {w} + {mirror(f'({i} % {w} + {dx})', w)} + 1]"


def laplacian(px: str, h: int = 8, w: int = 8) -> str:
    a = lambda dy, dx: at(px, dy, dx, str(h), str(w))
    return f"[{a(-1, 0)} + {a(1, 0)} + {a(0, -1)} + {a(0, 1)} - 4 * {px}[i + 1] FOR i IN range({h * w})]"


def smooth(px: str, h: int = 8, w: int = 8) -> str:
    terms = " + ".join(f"{(1 + (dy == 0)) * (1 + (dx == 0))} * {at(px, dy, dx, str(h), str(w))}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"[({terms} + 8) // 16 FOR i IN range({h * w})]"


def clip(x: str, low, high) -> str:
    return f"greatest({low}, least({high}, {x}))"


def steps(px: str, h: int, w: int, down: bool) -> str:
    if down:
        return f"[abs({px}[k + {w} + 1] - {px}[k + 1]) FOR k IN range({(h - 1) * w})]"
    return f"[abs({px}[k // {w - 1} * {w} + k % {w - 1} + 2] - {px}[k // {w - 1} * {w} + k % {w - 1} + 1]) FOR k IN range({h * (w - 1)})]"


#: Metric columns of the small rasters, in two steps so that each list is made once.
METRICS = (
    f"{SMALL}, lists AS (SELECT *, {laplacian('px')} AS lap, {smooth('px')} AS smo FROM small), resid AS (SELECT *, [px[i] - smo[i] FOR i IN range(1, 65)] AS res FROM lists), "
    f"metrics AS (SELECT photo_id, px, {mean('px')} AS brightness, {deviation('px')} AS contrast, {share('px', 'q < 35')} AS dark_35, {share('px', 'q <= 8')} AS dark_8, {share('px', 'q > 250')} AS light_250, {share('px', 'q > 248')} AS light_248, {share('px', 'q >= 250')} AS clipped_250, "
    f"{variance('lap')} AS blur, {deviation('res')} AS noise, 0.0::DOUBLE AS compression_axes, 0.0::DOUBLE AS compression_pooled, {percentile('px', 0.95)} - {percentile('px', 0.05)} AS dynamic_range FROM resid)"
)


def engine_quality(sharp: str, contrast: str, noise: str, dark: str, clipped: str) -> str:
    raw = f"35.0::DOUBLE + least(ln(1 + {sharp}) * 8.2::DOUBLE, 41.0::DOUBLE) + least({contrast} / 55.0::DOUBLE, 1.0::DOUBLE) * 23.0::DOUBLE - {clipped} * 95.0::DOUBLE - {dark} * 80.0::DOUBLE - greatest({noise} - 8.0::DOUBLE, 0.0::DOUBLE) * 0.9::DOUBLE"
    return clip(raw, "0.0::DOUBLE", "100.0::DOUBLE")


_PENALTY = "greatest(0.0, 70 - least(70.0::DOUBLE, blur)) * 0.38::DOUBLE + dark_35 * 34 + light_250 * 45 + greatest(0.0::DOUBLE, noise - 5) * 1.3::DOUBLE + greatest(0.0::DOUBLE, 34 - contrast) * 0.45::DOUBLE + CASE WHEN brightness < 55 OR brightness > 215 THEN 9.0::DOUBLE ELSE 0.0 END"
_SAFETY = "35.0::DOUBLE + least(ln(1 + blur) * 8.0::DOUBLE, 40.0::DOUBLE) + least(dynamic_range / 150.0::DOUBLE, 1.0::DOUBLE) * 24.0::DOUBLE - (noise * 0.7::DOUBLE + compression_pooled * 0.15::DOUBLE + dark_35 * 55.0::DOUBLE + light_248 * 70.0::DOUBLE)"
SCORED = (
    f"{METRICS}, scored AS (SELECT *, {clip(f'round_even(100 - ({_PENALTY}), 0)', 1.0, 100.0)}::INTEGER AS analyser, {engine_quality('blur', 'contrast', 'noise', 'dark_8', 'clipped_250')} AS engine, round_even({clip(_SAFETY, '0.0::DOUBLE', '100.0::DOUBLE')}, 0)::INTEGER AS safety, "
    "(photo_id % 4)::INTEGER AS face_count, CASE WHEN photo_id % 4 = 0 THEN 0.0 ELSE (photo_id % 40) / 1000.0 END AS smallest_face, (600 + photo_id % 7 * 200)::INTEGER AS height, (800 + photo_id % 5 * 200)::INTEGER AS width, photo_id % 11 = 0 AS is_screenshot, photo_id % 5 = 0 AS is_monochrome FROM metrics), "
    "inspected AS (SELECT *, least(height, width) < 1000 OR height::BIGINT * width < 1500000 AS is_low_resolution, round_even(engine, 0)::INTEGER AS quality_score FROM scored)"
)


def listed(*rows: tuple[str, str]) -> str:
    """A list of the names whose tests hold, in order."""
    return "[q FOR q IN [" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in rows) + "] IF q IS NOT NULL]"


def joined(items: str, by: str) -> str:
    return f"coalesce(array_to_string({items}, '{by}'), '')"


REASONS = listed(("blur < 35", "severe blur"), ("blur >= 35 AND blur < 75", "soft focus"), ("dark_35 > 0.28", "very dark"), ("light_250 > 0.10", "blown highlights"), ("noise > 10", "heavy noise"), ("analyser < 48", "low quality score"))
SCENE = "CASE WHEN face_count >= 2 THEN 'Group portrait' WHEN face_count = 1 THEN 'Portrait' WHEN brightness < 75 THEN 'Night / low light' WHEN width > height * 1.25 THEN 'Landscape / event' ELSE 'General photo' END"
PROBLEMS = listed(
    ("is_screenshot", "social-media or phone screenshot interface"), ("is_low_resolution", "low resolution"), ("compression_axes > 12", "JPEG compression artefacts"), ("blur < 120", "soft focus or blur"), ("noise > 8.5", "visible noise"),
    ("dark_35 > 0.14", "deep shadows"), ("light_248 > 0.05", "clipped highlights"), ("contrast < 36", "low contrast"), ("face_count > 0 AND smallest_face < 0.015", "small face detail"), ("is_monochrome", "black and white / monochrome image"),
)
TYPE = "CASE WHEN is_screenshot THEN 'Screenshot Recovery' WHEN is_monochrome THEN 'Black & White Restore' WHEN face_count > 0 THEN 'Portrait / People' WHEN dark_35 > 0.16 THEN 'Low Light' ELSE 'General Photograph' END"
ROUTED = "CASE WHEN is_screenshot THEN 'Screenshot Recovery' WHEN is_monochrome THEN 'Black & White Restore' WHEN quality_score >= 80 THEN 'Professional Light Polish' WHEN face_count > 0 THEN 'Identity-Safe Portrait Recovery' ELSE 'Automatic Photo Recovery' END"
STAGES = listed(
    ("is_screenshot", "crop screenshot interface"), ("is_screenshot OR compression_axes > 12", "repair JPEG compression"), ("noise > 8.5", "adaptive denoise"), ("blur < 160", "edge-limited detail recovery"), ("is_monochrome", "restore monochrome contrast"),
    ("is_monochrome", "recover local tonal detail"), ("dark_35 > 0.08", "recover shadows"), ("light_248 > 0.03", "compress highlights"), ("face_count > 0", "identity-safe face lighting"), ("true", "professional colour and lighting"), ("true", "quality validation with retry"),
)
ASKED = listed(
    ("is_screenshot OR compression_axes > 12", "jpeg_repair"), ("noise > 8.5", "denoise"), ("blur < 160", "deblur"), ("face_count > 0 AND (smallest_face < 0.025 OR blur < 220 OR is_screenshot)", "face_recovery"), ("face_count > 0", "face_protect"),
    ("dark_35 > 0.08", "lighting"), ("NOT is_monochrome", "colour"), ("is_low_resolution OR is_screenshot", "super_resolution"),
)
PAIRS = f"{SMALL}, pairs AS (SELECT a.photo_id, a.px, CASE WHEN b.px IS NULL THEN a.px WHEN a.photo_id % 2 = 0 THEN [(15 * a.px[i] + b.px[i]) // 16 FOR i IN range(1, 65)] ELSE b.px END AS out_px FROM small a LEFT JOIN small b ON b.photo_id = a.photo_id + 1)"


def correlation(a: str, b: str, strict: bool) -> str:
    va, vb = (f"(len({x}) * list_sum([q::BIGINT * q FOR q IN {x}]) - list_sum({x}) * list_sum({x}))" for x in (a, b))
    cab = f"(len({a}) * list_sum([{a}[i]::BIGINT * {b}[i] FOR i IN range(1, len({a}) + 1)]) - list_sum({a}) * list_sum({b}))"
    value = clip(f"{cab}::DOUBLE / greatest(sqrt({va}::DOUBLE) * sqrt({vb}::DOUBLE), 1e-300)", "-1.0::DOUBLE", "1.0::DOUBLE")
    if strict:
        flat = clip(f"1.0::DOUBLE - abs({mean(a)} - {mean(b)}) / 255.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")
        return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 1.0::DOUBLE WHEN {va} = 0 AND {vb} = 0 THEN {flat} WHEN {va} = 0 OR {vb} = 0 THEN 0.0::DOUBLE ELSE {value} END"
    return f"CASE WHEN len({a}) <> len({b}) OR len({a}) = 0 THEN 0.0::DOUBLE WHEN {va} = 0 OR {vb} = 0 THEN 1.0::DOUBLE ELSE {value} END"


_TARGETS = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in rules.TARGETS)
_NAMES = "[" + ", ".join(f"'{t[0]}'" for t in rules.TARGETS) + ", 'Unknown']"
_END = "q <= 5 OR q >= 250"
VALIDATED = (
    f"{PAIRS}, limits(target, min_identity, min_structure, max_clip, max_sharp) AS (VALUES {_TARGETS}), "
    f"measured AS (SELECT photo_id, CASE WHEN photo_id % 6 = 5 THEN 'Professional' ELSE {_NAMES}[photo_id % 6 + 1] END AS target, CASE WHEN photo_id % 3 = 0 THEN 0.90::DOUBLE ELSE 1.0::DOUBLE END AS identity, {correlation('px', 'out_px', True)} AS structure, "
    f"greatest(0.0::DOUBLE, {share('out_px', _END)} - {share('px', _END)}) AS clip_delta, {variance('lap_out')} / ({variance('lap')} + 1e-6::DOUBLE) AS sharp_ratio FROM (SELECT *, {laplacian('px')} AS lap, {laplacian('out_px')} AS lap_out FROM pairs)), "
    f"validated AS (SELECT *, {listed(('identity < min_identity', 'identity'), ('structure < min_structure', 'structure'), ('clip_delta > max_clip', 'clipping'), ('sharp_ratio > max_sharp', 'sharpness'))} AS reasons FROM measured JOIN limits USING (target))"
)
HORIZON = "angles AS (SELECT vec_id, [q FOR q IN list_sort([((vec_id * 37 + k * 53) % 720)::DOUBLE / 4 - 90 FOR k IN range(5)]) IF abs(q) <= 12] AS level FROM embeddings), horizon AS (SELECT vec_id, CASE WHEN len(level) = 0 THEN 0.0::DOUBLE ELSE (level[(len(level) - 1) // 2 + 1] + level[len(level) // 2 + 1]) / 2 END AS angle FROM angles)"
_SIG_MEDIAN = "list_aggregate([q::DOUBLE FOR q IN embedding[9:64]], 'quantile_cont', 0.5)"
#: The 64 bits as 16 digits of four bits each.
_DIGITS = "array_to_string([substr('0123456789abcdef', (8 * bits[4 * k + 1] + 4 * bits[4 * k + 2] + 2 * bits[4 * k + 3] + bits[4 * k + 4] + 1)::INTEGER, 1) FOR k IN range(16)], '')"
SIGNATURES = f"bits AS (SELECT vec_id AS photo_id, [CASE WHEN q::DOUBLE > med THEN 1 ELSE 0 END FOR q IN embedding] AS bits FROM (SELECT *, {_SIG_MEDIAN} AS med FROM embeddings))"
FACES = f"{SMALL}, boxes AS (SELECT photo_id, px, k, ((photo_id + k) % 5)::INTEGER AS x, ((photo_id * 3 + k) % 5)::INTEGER AS y, (2 + photo_id % 2)::INTEGER AS w, (2 + k % 2)::INTEGER AS h FROM (SELECT *, unnest(range(1, photo_id % 4 + 1)) AS k FROM small WHERE photo_id % 4 > 0))"
PROFILED = (
    f"{FACES}, rois AS (SELECT *, [px[(y + i // w) * 8 + x + i % w + 1] FOR i IN range(w * h)] AS roi FROM boxes), laps AS (SELECT *, [{at('roi', -1, 0, 'h', 'w')} + {at('roi', 1, 0, 'h', 'w')} + {at('roi', 0, -1, 'h', 'w')} + {at('roi', 0, 1, 'h', 'w')} - 4 * roi[i + 1] FOR i IN range(w * h)] AS lap FROM rois), "
    f"profiled AS (SELECT *, w * h / 64.0::DOUBLE AS area_ratio, {mean('roi')} AS brightness, {deviation('roi')} AS contrast, {variance('lap')} AS sharpness FROM laps), levelled AS (SELECT *, CASE WHEN area_ratio < 0.012 OR sharpness < 35 THEN 'Maximum' WHEN area_ratio < 0.035 OR sharpness < 80 THEN 'High' ELSE 'Normal' END AS level FROM profiled)"
)
_STRATEGY_ROWS = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else (str(v) if isinstance(v, int) else f"{v}::DOUBLE") for v in row) + ")" for row in candidates.STRATEGIES)
STRATEGIES = f"strategies(ordinal, strategy, crop_top, crop_bottom, detail, shift, saturation, blend, gamma, shadow, highlight_cut) AS (VALUES {_STRATEGY_ROWS})"
_GAMMA = "floor(pow(q / 255.0::DOUBLE, gamma) * 255)"
_DARKNESS = "((255 - q) / 255.0::DOUBLE * shadow)"
TRIED = (
    f"{SCORED}, {STRATEGIES}, planned AS (SELECT *, {ROUTED} AS plan FROM inspected), expanded AS (SELECT p.*, s.* FROM planned p JOIN strategies s ON CASE WHEN plan = 'Professional Light Polish' THEN ordinal < 2 ELSE true END), "
    f"detailed AS (SELECT *, CASE WHEN blur < 180 THEN [{clip('round_even((1 + detail) * px[j] - detail * smo[j], 0)', '0.0::DOUBLE', '255.0::DOUBLE')}::INTEGER FOR j IN range(1, 65)] ELSE px END AS work FROM (SELECT *, {smooth('px')} AS smo FROM expanded)), "
    f"lifted AS (SELECT * REPLACE (CASE WHEN dark_35 > 0.08 THEN [{clip(f'floor(q * (1 - {_DARKNESS}) + {_GAMMA} * {_DARKNESS})', '0.0::DOUBLE', '255.0::DOUBLE')}::INTEGER FOR q IN work] ELSE work END AS work) FROM detailed), "
    f"cut AS (SELECT * REPLACE (CASE WHEN light_248 > 0.03 THEN [{clip('floor(q - ' + clip('(q - 188) / 67.0::DOUBLE', '0.0::DOUBLE', '1.0::DOUBLE') + ' * highlight_cut)', '0.0::DOUBLE', '255.0::DOUBLE')}::INTEGER FOR q IN work] ELSE work END AS work) FROM lifted), "
    f"worked AS (SELECT *, {laplacian('work')} AS wlap, {smooth('work')} AS wsmo FROM cut), residual AS (SELECT *, [work[i] - wsmo[i] FOR i IN range(1, 65)] AS wres FROM worked), "
    f"tried AS (SELECT photo_id, ordinal, strategy, is_screenshot, round(engine, 6) AS before, round({engine_quality(variance('wlap'), deviation('work'), deviation('wres'), share('work', 'q <= 8'), share('work', 'q >= 250'))}, 6) AS after FROM residual)"
)
_CAPABILITIES = "[" + ", ".join(f"'{c}'" for c in (*packs.CAPABILITIES, "translate")) + "]"
_SOBEL_X = f"abs({at('px', -1, 1)} + 2 * {at('px', 0, 1)} + {at('px', 1, 1)} - {at('px', -1, -1)} - 2 * {at('px', 0, -1)} - {at('px', 1, -1)})"
_SOBEL_Y = f"abs({at('px', 1, -1)} + 2 * {at('px', 1, 0)} + {at('px', 1, 1)} - {at('px', -1, -1)} - 2 * {at('px', -1, 0)} - {at('px', -1, 1)})"
_ALIASES = "CASE m " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.MODE_ALIASES.items()) + " ELSE m END"
_MODES = "[" + ", ".join(f"'{m}'" for m in (*rules.MODE_ALIASES, "Auto Enhance", "Advanced")) + "]"


def _edges(part: str) -> str:
    return f"{share(part, 'q > 170')} * 100.0::DOUBLE"


_SOCIAL = clip(
    f"{_edges('top')} * 1.8::DOUBLE + {_edges('bottom')} * 1.5::DOUBLE + greatest(0.0::DOUBLE, 20.0 - {deviation('top')}) * 0.35::DOUBLE + greatest(0.0::DOUBLE, 20.0 - {deviation('bottom')}) * 0.55::DOUBLE + least(abs({mean('top')} - {mean('middle')}) + abs({mean('bottom')} - {mean('middle')}), 80.0::DOUBLE) / 4.0::DOUBLE + CASE WHEN (24 + photo_id % 3 * 10) / 24.0::DOUBLE > 1.5 THEN 16.0::DOUBLE ELSE 0.0::DOUBLE END",
    "0.0::DOUBLE", "100.0::DOUBLE",
)
_ASPECT = "((24 + photo_id % 3 * 10) / 24.0::DOUBLE)"
_LAYOUT = "CASE WHEN k % 3 = 0 THEN 'nhwc' WHEN k % 3 = 1 THEN 'weird' ELSE 'auto' END"
_BLEND = "(k / 60.0::DOUBLE)"
_RAMP = lambda p, n: f"CASE WHEN {p} >= {n} - 1 THEN 0.08::DOUBLE WHEN {p} < 1 THEN 0.08::DOUBLE ELSE 1.0::DOUBLE END"
_PACK_FILES = (
    "SELECT source AS pack_id, doc_id AS position, 'doc-' || doc_id || '.onnx' AS filename, CASE WHEN doc_id % 7 = 3 THEN strlen(text) + 1 WHEN doc_id % 5 = 0 THEN 0 ELSE strlen(text) END AS size, CASE WHEN doc_id % 11 = 5 THEN repeat('0', 64) WHEN doc_id % 4 = 0 THEN '' ELSE sha256(text) END AS sha, doc_id % 2 = 0 AS required, "
    "CASE WHEN doc_id % 9 <> 4 THEN strlen(text) END AS actual_size, CASE WHEN doc_id % 9 <> 4 THEN sha256(text) END AS actual_sha FROM documents"
)
_FAULT = "CASE WHEN actual_size IS NULL THEN CASE WHEN required THEN 'Missing required model: ' || filename END WHEN size <> 0 AND actual_size <> size THEN 'Wrong size for ' || filename || ': expected ' || size || ', got ' || actual_size WHEN sha <> '' AND actual_sha <> sha THEN 'Checksum failed for ' || filename END"
_OUTCOME = "CASE WHEN len(missing) > 0 THEN 'missing dependency' WHEN row_number() OVER (PARTITION BY photo_id, len(missing) = 0 ORDER BY pack_type = 'hybrid-core' DESC, profile_order) <= 2 THEN 'applied' ELSE 'limit reached' END"


def _profiles() -> str:
    from rasterflow.queries import PROFILES

    text = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    return ", ".join(f"({o}, '{i}', '{t}', {text(h)}, {text(d)})" for o, i, t, h, d in PROFILES)


def _flip_sum() -> str:
    """Bits of a copy: each position's bit, flipped when an odd number of its key's flips fall on it."""
    flips = " + ".join(f"CASE WHEN photo_id % 10 > {k} AND 63 - p = (photo_id * 7 + {k * 13}) % 64 THEN 1 ELSE 0 END" for k in range(9))
    return f"[(bits[p + 1] + {flips}) % 2 FOR p IN range(64)]"


def _groups() -> str:
    """members (grp, position, ord, leader): files walked one by one in order, with all groups so far in lists."""
    flips = "sig"
    for k in range(9):
        flips = f"xor({flips}, CASE WHEN key % 10 > {k} THEN 1::UBIGINT << ((key * 7 + {k * 13}) % 64) ELSE 0::UBIGINT END)"
    digits = lambda a, n: f"('0x' || substr(sha, {a}, {n}))::BIGINT"
    new = "CASE WHEN f.first < f.ord OR coalesce(list_position([bit_count(xor(s, f.sig)) <= 7 FOR s IN w.sigs], true), 0) = 0 THEN len(w.sigs) + 1 ELSE list_position([bit_count(xor(s, f.sig)) <= 7 FOR s IN w.sigs], true) END"
    return (
        f"WITH RECURSIVE {SIGNATURES}, words AS (SELECT photo_id, list_sum([bits[k + 1]::UBIGINT * (1::UBIGINT << (63 - k)) FOR k IN range(64)])::UBIGINT AS sig FROM bits), "
        f"docs AS (SELECT doc_id AS ord, sha256(coalesce(text, '')) AS sha FROM documents), keyed AS (SELECT ord, sha, {digits(1, 8)} % (SELECT count(*) FROM embeddings) AS photo_id, ({digits(9, 4)} % 1000)::INTEGER AS key FROM docs), "
        f"files AS (SELECT ord, sha, {flips} AS sig, row_number() OVER (ORDER BY ord) AS i, min(ord) OVER (PARTITION BY sha) AS first FROM keyed JOIN words USING (photo_id)), "
        f"w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BIGINT AS first, 0::BIGINT AS g, []::UBIGINT[] AS sigs, []::BIGINT[] AS leaders UNION ALL "
        f"SELECT i, ord, first, g, CASE WHEN g > len(sigs) THEN list_append(sigs, sig) ELSE sigs END, CASE WHEN g > len(leaders) THEN list_append(leaders, first) ELSE leaders END FROM (SELECT f.i, f.ord, f.first, f.sig, w.sigs, w.leaders, ({new})::BIGINT AS g FROM w JOIN files f ON f.i = w.i + 1)), "
        f"walked AS (SELECT g, ord, 1 AS late, leaders[g] AS leader FROM w WHERE i > 0 AND ord = first UNION ALL SELECT g, unnest([first, ord]) AS ord, 0 AS late, first AS leader FROM w WHERE i > 0 AND ord > first), "
        f"several AS (SELECT g, row_number() OVER (ORDER BY g) AS grp FROM walked GROUP BY g HAVING count(*) > 1), "
        f"members AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY late, ord) - 1 AS position, ord, leader FROM walked JOIN several USING (g)), "
        f"judged AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, position) = 1 AS is_best FROM (SELECT members.*, coalesce(quality, 0) AS score FROM members LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = ord))"
    )


def _told() -> str:
    name, out = "pack_id", _OUTCOME
    said = f"CASE WHEN len(missing) > 0 THEN 'Skipped ' || {name} || ': install ' || array_to_string(missing, ', ') || ' first' WHEN outcome = 'applied' THEN 'Applied installed profile: ' || {name} ELSE 'Skipped ' || {name} || ': safe profile stacking limit reached' END"
    return (
        f"{SCORED}, profiles(profile_order, pack_id, pack_type, hints, needs) AS (VALUES {_profiles()}), m AS (SELECT photo_id, profile_order, pack_id, pack_type, [q FOR q IN needs IF q NOT IN ('auto-restoration-core', 'auto-heritage')] AS missing FROM inspected JOIN profiles ON CASE WHEN len(hints) = 0 THEN pack_type = 'hybrid-core' ELSE len([q FOR q IN hints IF contains(lower({TYPE} || ' ' || {SCENE}), lower(q))]) > 0 END), "
        f"o AS (SELECT *, {out} AS outcome FROM m), told AS (SELECT photo_id, {said} AS message, row_number() OVER (PARTITION BY photo_id ORDER BY pack_type <> 'hybrid-core', profile_order) - 1 AS place FROM o), "
        "done AS (SELECT photo_id, pack_id, row_number() OVER (PARTITION BY photo_id ORDER BY pack_type <> 'hybrid-core', profile_order) - 1 AS place FROM o WHERE outcome = 'applied')"
    )


_MODELS = "[" + ", ".join(f"'{c}'" for c in packs.CAPABILITIES) + "]"
_FIVE = f"{_MODELS}[1:5]"


def oracle_sql() -> dict[str, str]:
    groups = _groups()
    return {
        "duplicate_groups": f'{groups} SELECT grp AS "group", position, ord, leader FROM members',
        "best_of_group": f'{groups} SELECT grp AS "group", ord AS doc_id, score FROM judged WHERE is_best',
        "duplicate_outputs": f"""{groups} SELECT grp AS "group", ord AS doc_id, 'Duplicate Review/Group ' || CASE WHEN grp < 1000 THEN lpad(grp::VARCHAR, 3, '0') ELSE grp::VARCHAR END || '/doc-' || ord || CASE WHEN is_best THEN '_BEST' ELSE '' END || '.jpg' AS copy, CASE WHEN is_best THEN 'Best Photos/doc-' || ord || '_enhanced.jpg' END AS best_copy FROM judged""",
        "dead_letters": "SELECT vec_id AS photo_id, 'Review Needed/photo-' || vec_id || '_ERROR.txt' AS error_file, 'unreadable' AS error FROM embeddings WHERE vec_id % 29 = 0",
        "source_index": "SELECT page_id, path, row_number() OVER (ORDER BY path) AS place FROM (SELECT page_id, '/photos/' || regexp_replace(url, '^[a-z]+://', '') || '/im' || page_id || CASE page_id % 3 WHEN 0 THEN '.jpg' ELSE '.png' END AS path FROM pages WHERE page_id % 3 <> 2)",
        "profile_messages": f"WITH {_told()} SELECT photo_id, place, 'profile:' || pack_id AS step, message FROM done JOIN told USING (photo_id, place)",
        "pack_duplicates": "SELECT l_suppkey AS pack_id, p_brand AS capability, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(*) > 1",
        "installed_map": f"WITH c AS (SELECT unnest({_MODELS}) AS capability, unnest(range(9)) AS k), f AS (SELECT {_MODELS}[l_partkey % 5 + 1] AS capability, 'm-' || l_partkey || '.onnx' AS filename FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_partkey % 5 ORDER BY l_suppkey, l_orderkey * 8 + l_linenumber, l_partkey::VARCHAR) = 1), m AS (SELECT capability, coalesce(f.filename, CASE WHEN n_nationkey IS NOT NULL THEN capability || CASE WHEN capability = 'super_resolution' THEN '_x2' ELSE '' END || '.onnx' END) AS filename FROM c LEFT JOIN f USING (capability) LEFT JOIN nation ON n_nationkey = k AND k <> 6 AND k <> 0) SELECT row_number() OVER (ORDER BY capability) - 1 AS place, capability, filename FROM m WHERE filename IS NOT NULL",
        "capability_steps": f"WITH {SCORED}, a AS (SELECT photo_id, {ASKED} AS asked FROM inspected) SELECT photo_id, {joined(f'[z FOR z IN asked IF list_contains({_FIVE}, z)]', ',')} AS applied, {joined(f'[z FOR z IN asked IF NOT list_contains({_FIVE}, z)]', ',')} AS missing FROM a",
        "spec_priority": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 100 WHEN event_id % 5 = 0 THEN 200 WHEN event_id % 3 = 0 THEN 300 + event_id % 10 WHEN event_id % 11 = 2 THEN 256 WHEN event_id % 2 = 0 THEN 400 ELSE 256 END AS tile_size FROM events",
        "raster_tone": f"WITH {METRICS} SELECT photo_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(dark_35, 6) AS dark_35, round(dark_8, 6) AS dark_8, round(light_250, 6) AS light_250, round(light_248, 6) AS light_248, round(clipped_250, 6) AS clipped_250 FROM metrics",
        "raster_focus": f"WITH {METRICS} SELECT photo_id, round(blur, 4) AS blur, round(noise, 6) AS noise FROM metrics",
        "raster_blockiness": f"WITH {tiled(3)}, s AS (SELECT photo_id, {steps('px', 24, 24, False)} AS a, {steps('px', 24, 24, True)} AS d FROM tiled), e AS (SELECT *, [a[k + 1] FOR k IN range(552) IF k % 23 % 8 = 7] AS ab, [d[k + 1] FOR k IN range(552) IF k // 24 % 8 = 7] AS db FROM s) SELECT photo_id, round({clip(f'(({mean("ab")} / ({mean("a")} + 1e-6::DOUBLE) + {mean("db")} / ({mean("d")} + 1e-6::DOUBLE)) / 2 - 0.88::DOUBLE) * 120.0::DOUBLE', '0.0::DOUBLE', '100.0::DOUBLE')}, 6) AS compression_axes, round({clip(f'((({mean("ab")} + {mean("db")}) / 2) / (({mean("a")} + {mean("d")}) / 2 + 1e-6::DOUBLE) - 0.9::DOUBLE) * 115.0::DOUBLE', '0.0::DOUBLE', '100.0::DOUBLE')}, 6) AS compression_pooled FROM e",
        "raster_dynamic_range": f"WITH {METRICS} SELECT photo_id, round(dynamic_range, 6) AS dynamic_range FROM metrics",
        "raster_colour": f"WITH {COLOUR}, px AS (SELECT *, [greatest(b[i], g[i], r[i]) FOR i IN range(1, 65)] AS hi, [least(b[i], g[i], r[i]) FOR i IN range(1, 65)] AS lo FROM colour), s AS (SELECT *, [CASE WHEN hi[i] = 0 THEN 0 ELSE (510 * (hi[i] - lo[i]) + hi[i]) // (2 * hi[i]) END FOR i IN range(1, 65)] AS sat, [hi[i] - lo[i] FOR i IN range(1, 65)] AS spr FROM px) SELECT photo_id, round(greatest({mean('b')}, {mean('g')}, {mean('r')}) - least({mean('b')}, {mean('g')}, {mean('r')}), 6) AS colour_cast, round({mean('sat')}, 6) AS saturation, round({percentile('sat', 0.9)}, 6) AS saturation_p90, round({mean('spr')}, 6) AS channel_spread, {percentile('sat', 0.9)} < 18 AS is_monochrome, {mean('spr')} < 9 AS is_gray_scan FROM s",
        "raster_gradients": f"WITH {SMALL}, g AS (SELECT photo_id, [{_SOBEL_X} FOR i IN range(64)] AS gx, [{_SOBEL_Y} FOR i IN range(64)] AS gy FROM small), m AS (SELECT photo_id, {mean('gx')} AS x, {mean('gy')} AS y FROM g) SELECT photo_id, round(x, 6) AS gradient_x, round(y, 6) AS gradient_y, CASE WHEN x < y * 0.78 THEN 1.8 WHEN y < x * 0.78 THEN 0.7 ELSE 1.15 END::DOUBLE AS sigma_x, CASE WHEN x < y * 0.78 THEN 0.7 WHEN y < x * 0.78 THEN 1.8 ELSE 1.15 END::DOUBLE AS sigma_y FROM m",
        "low_light_gate": f"WITH {SMALL} SELECT photo_id, round({percentile('px', 0.5)}, 6) AS median_luma, round({share('px', 'q < 55')}, 6) AS share_55, NOT ({percentile('px', 0.5)} > 112 AND {share('px', 'q < 55')} < 0.16) AS night_applies FROM small",
        "quality_scores": f"WITH {SCORED} SELECT photo_id, analyser, round(engine, 5) AS engine, safety FROM inspected",
        "review_reasons": f"WITH {SCORED} SELECT photo_id, {joined(REASONS, ', ')} AS review_reason FROM inspected",
        "scene_rollup": f"WITH {SCORED} SELECT {SCENE} AS scene, count(*) AS photos, round(avg(analyser), 6) AS mean_score, count(*) FILTER (len({REASONS}) > 0) AS for_review FROM inspected GROUP BY 1",
        "problem_list": f"WITH {SCORED} SELECT photo_id, {joined(PROBLEMS, '; ')} AS problems, {TYPE} AS image_type, greatest(62, least(97, 62 + 5 * len({PROBLEMS}))) AS confidence FROM inspected",
        "plan_stages": f"WITH {SCORED} SELECT photo_id, CASE WHEN photo_id % 9 = 0 THEN 'Auto Portrait' ELSE {ROUTED} END AS plan, {joined(STAGES, '; ')} AS stages FROM inspected",
        "capability_request": f"WITH {SCORED}, u AS (SELECT *, photo_id % 3 = 0 AS four_k FROM inspected) SELECT photo_id, {joined(f'[z FOR z IN {ASKED} IF four_k OR is_screenshot OR least(height, width) < 720 OR z <> {chr(39)}super_resolution{chr(39)}]', ',')} AS requested, CASE WHEN NOT four_k AND (is_screenshot OR least(height, width) < 720) THEN '2x' WHEN four_k AND greatest(height, width) < 3840 THEN '4k' ELSE 'none' END AS fallback FROM u",
        "capability_counts": f"WITH {SCORED}, a AS (SELECT {ASKED} AS asked FROM inspected), x AS (SELECT unnest(asked) AS capability, unnest(range(len(asked))) AS place FROM a) SELECT capability, count(*) AS n, min(place) AS first_place FROM x GROUP BY 1",
        "exact_duplicates": "SELECT doc_id, sha, first_doc, copies, doc_id = first_doc AS is_first FROM (SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1",
        "signature_bits": f"WITH {SIGNATURES} SELECT photo_id, {_DIGITS} AS phash, list_sum(bits)::BIGINT AS ones FROM bits",
        "near_pairs": f"WITH {SIGNATURES}, copies AS (SELECT photo_id AS copy_id, {_flip_sum()} AS bits FROM bits), d AS (SELECT a.photo_id, b.copy_id, list_sum([abs(a.bits[i] - b.bits[i]) FOR i IN range(1, 65)])::BIGINT AS distance FROM bits a, copies b) SELECT * FROM d WHERE distance <= 7",
        "strategy_accept": f"WITH {TRIED}, best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY after DESC, ordinal) = 1), a AS (SELECT *, after + CASE WHEN is_screenshot THEN 4.0 ELSE 1.5 END >= before AS accepted FROM best) SELECT photo_id, strategy, round(before, 3) AS before, round(CASE WHEN accepted THEN after ELSE before END, 3) AS after, accepted, round(CASE WHEN accepted THEN after - before ELSE 0.0 END, 3) AS improvement FROM a",
        "pair_correlation": f"WITH {PAIRS}, f AS (SELECT photo_id, px, CASE WHEN photo_id % 17 = 0 THEN [90 FOR q IN out_px] ELSE out_px END AS out_px FROM pairs) SELECT photo_id, round({correlation('px', 'out_px', True)}, 6) AS strict, round({correlation('px', 'out_px', False)}, 6) AS lenient FROM f",
        "post_validation": f"WITH {VALIDATED} SELECT photo_id, target, round(structure, 6) AS structure, round(clip_delta, 6) AS clip_delta, round(ln(1 + sharp_ratio), 5) AS log_sharp_ratio, {joined('reasons', ',')} AS reasons, len(reasons) = 0 AS accepted FROM validated",
        "candidate_rank": f"WITH {VALIDATED}, s AS (SELECT photo_id // 4 AS reference, photo_id % 4 AS candidate, len(reasons) = 0 AS accepted, identity * 0.62::DOUBLE + round(structure, 6) * 0.38::DOUBLE - (round(clip_delta, 6) * 8.0::DOUBLE + greatest(0.0::DOUBLE, round(sharp_ratio, 6) - 1.0) * 0.03::DOUBLE) AS score FROM validated) SELECT reference, count(*) OVER (PARTITION BY reference) AS attempted, count(*) FILTER (accepted) OVER (PARTITION BY reference) AS accepted_candidates, candidate AS chosen, accepted, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY reference ORDER BY accepted DESC, score DESC, candidate) = 1",
        "review_flag": f"WITH {SCORED} SELECT photo_id, {_needed()} AS review_needed FROM inspected",
        "batch_counters": f"WITH {SCORED} SELECT photo_id % 3 AS root, count(*) FILTER (photo_id % 29 <> 0) AS completed, count(*) FILTER (photo_id % 29 = 0 OR {_needed()}) AS review, count(*) FILTER (photo_id % 29 = 0) AS failed FROM inspected GROUP BY 1",
        "batch_totals": f"SELECT * FROM (WITH {SCORED} SELECT count(*) FILTER (photo_id % 29 <> 0) AS completed, count(*) FILTER (photo_id % 29 = 0 OR {_needed()}) AS review, count(*) FILTER (photo_id % 29 = 0) AS failed FROM inspected), ({groups} SELECT count(*) FILTER (position > 0) AS duplicates FROM members)",
        "report_rows": f"WITH {SCORED}, {HORIZON} SELECT 'photo-' || lpad(photo_id::VARCHAR, 6, '0') || '.jpg' AS filename, analyser AS quality_score, {SCENE} AS scene, round(round_even(blur, 2), 1) AS blur_score, round(round_even(brightness, 2), 1) AS brightness, round(round_even(dark_35, 4), 3) AS dark_fraction, round(round_even(light_250, 4), 3) AS clipped_highlights, round(round_even(contrast, 2), 1) AS contrast, round(round_even(noise, 2), 1) AS noise_score, face_count, round(round_even(angle, 2), 1) AS horizon_angle, {joined(REASONS, ', ')} AS review_reason FROM inspected JOIN horizon ON vec_id = photo_id",
        "face_profiles": f"WITH {PROFILED} SELECT photo_id, k, round(area_ratio, 6) AS area_ratio, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(sharpness, 4) AS sharpness, level, CASE level WHEN 'Maximum' THEN 0.10::DOUBLE WHEN 'High' THEN 0.16::DOUBLE ELSE 0.24::DOUBLE END AS most_change FROM levelled",
        "face_summary": f"WITH {PROFILED}, s AS (SELECT photo_id, count(*) AS n, min(area_ratio) AS m, bool_or(level = 'Maximum') AS x FROM levelled GROUP BY 1) SELECT vec_id AS photo_id, coalesce(n, 0) AS face_count, round(coalesce(m, 0.0::DOUBLE), 6) AS smallest_face, coalesce(x, false) AS any_maximum FROM embeddings LEFT JOIN s ON photo_id = vec_id",
        "face_similarity": f"WITH {FACES}, pairs AS (SELECT a.photo_id, CASE WHEN b.px IS NULL THEN a.px WHEN a.photo_id % 2 = 0 THEN [(15 * a.px[i] + b.px[i]) // 16 FOR i IN range(1, 65)] ELSE b.px END AS out_px FROM small a LEFT JOIN small b ON b.photo_id = a.photo_id + 1), p AS (SELECT boxes.photo_id, px, out_px, greatest(0, x - (greatest(w, h) * 0.12::DOUBLE)::INTEGER) AS x0, greatest(0, y - (greatest(w, h) * 0.12::DOUBLE)::INTEGER) AS y0, least(8, x + w) AS x1, least(8, y + h) AS y1 FROM boxes JOIN pairs USING (photo_id)), c AS (SELECT photo_id, [px[(y0 + i // (x1 - x0)) * 8 + x0 + i % (x1 - x0) + 1] FOR i IN range((x1 - x0) * (y1 - y0))] AS a, [out_px[(y0 + i // (x1 - x0)) * 8 + x0 + i % (x1 - x0) + 1] FOR i IN range((x1 - x0) * (y1 - y0))] AS b FROM p), s AS (SELECT photo_id, min({correlation('a', 'b', True)}) AS m, count(*) AS n FROM c GROUP BY 1) SELECT pairs.photo_id, round(coalesce(m, 1.0::DOUBLE), 6) AS identity, coalesce(n, 0) AS faces FROM pairs LEFT JOIN s USING (photo_id)",
        "profile_outcomes": f"WITH {SCORED}, profiles(profile_order, pack_id, pack_type, hints, needs) AS (VALUES {_profiles()}), m AS (SELECT photo_id, profile_order, pack_id, pack_type, [q FOR q IN needs IF q NOT IN ('auto-restoration-core', 'auto-heritage')] AS missing FROM inspected JOIN profiles ON CASE WHEN len(hints) = 0 THEN pack_type = 'hybrid-core' ELSE len([q FOR q IN hints IF contains(lower({TYPE} || ' ' || {SCENE}), lower(q))]) > 0 END) SELECT photo_id, pack_id, {_OUTCOME} AS outcome, {joined('missing', ',')} AS missing FROM m",
        "capability_resolution": "WITH f AS (SELECT p_brand AS capability, l_suppkey AS supplier, l_orderkey * 8 + l_linenumber AS position, p_name AS filename FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND l_returnflag <> 'R'), c AS (SELECT DISTINCT p_brand AS capability FROM part) SELECT c.capability, supplier, filename FROM c LEFT JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY capability ORDER BY supplier, position, filename) = 1) USING (capability)",
        "manifest_validation": f"WITH f AS ({_PACK_FILES}), e AS (SELECT *, {_FAULT} AS error FROM f) SELECT pack_id, count(*) AS n_files, count(error) AS n_errors, arg_min(error, position) FILTER (error IS NOT NULL) AS first_error, count(error) = 0 AS valid FROM e GROUP BY 1",
        "pack_lint": f"WITH f AS (SELECT {_CAPABILITIES}[l_partkey % 10 + 1] AS capability, CASE WHEN l_orderkey % 31 = 0 THEN '' WHEN l_orderkey % 29 = 0 THEN '../m.onnx' ELSE 'models/m.onnx' END AS filename, l_quantity::BIGINT AS size, l_returnflag = 'A' AS no_hash, [q FOR q IN [CASE WHEN l_linenumber % 3 <> 0 THEN 'CPUExecutionProvider' END, CASE WHEN l_orderkey % 5 = 0 THEN 'CUDAExecutionProvider' END, CASE WHEN l_orderkey % 17 = 0 THEN 'OtherProvider' END] IF q IS NOT NULL] AS providers, CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT + (l_linenumber = 1)::INTEGER END AS actual_size, l_tax < 0.06 AS hash_fits FROM lineitem), "
        f"c AS (SELECT *, filename <> '' AND filename <> '../m.onnx' AND actual_size IS NOT NULL AS checked FROM f), e AS (SELECT {_lint()} AS faults FROM c) SELECT fault, count(*) AS files FROM (SELECT unnest(faults) AS fault FROM e) GROUP BY 1",
        "spec_parse": f"WITH e AS (SELECT event_id, event_type, (props->>'k')::INTEGER AS k FROM events) SELECT event_id, {_LAYOUT} AS layout, greatest(64, k * 4) AS tile_size, greatest(0, k - 20) AS overlap, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_BLEND})), 6) AS blend_strength, {joined(listed(('k % 3 = 1', 'layout'), ('k * 4 < 64', 'tile_size'), ('k - 20 < 0 OR k - 20 >= (k * 4) // 2', 'overlap'), (f'{_BLEND} < 0 OR {_BLEND} > 1', 'blend_strength'), ("event_type = 'click' AND " + _BLEND + ' > 0.5', 'face blend_strength')), ',')} AS faults FROM e",
        "service_response": "SELECT conv_id, count(*) AS images, sum(strlen(text))::BIGINT AS bytes, greatest(1, least(count(*), 4)) AS asked FROM conversations WHERE turn % 3 <> 2 AND text <> '' GROUP BY 1",
        "output_paths": "WITH p AS (SELECT page_id, '/photos/' || regexp_replace(url, '^[a-z]+://', '') || '/im' || page_id AS base, ['.JPG', '.png', '.gif', '.jpeg', '.txt', '.Tiff', '', '.webp'][page_id % 8 + 1] AS ext FROM pages), q AS (SELECT page_id, regexp_replace(base, '/[^/]*$', '') AS dir, regexp_extract(base, '([^/]*)$', 1) || '_enhanced.jpg' AS name, lower(ext) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') AS supported FROM p) SELECT page_id, supported, dir || '/Professionally Enhanced/' || name AS beside, '/photos/Professionally Enhanced' || substr(dir, 8) || '/' || name AS below_root FROM q",
        "mode_names": f"WITH e AS (SELECT {_MODES}[user_id % 12 + 1] AS m, event_id % 3 AS f FROM events), n AS (SELECT {_ALIASES} AS mode, f FROM e) SELECT mode, CASE WHEN mode = 'Auto Enhance' THEN 'natural' WHEN mode IN ('Auto Restore', 'Auto Screenshot Recovery') THEN 'maximum' WHEN mode IN ('Auto Portrait', 'Auto Celebrations') THEN 'strong' WHEN f = 0 THEN 'natural' WHEN f = 1 THEN 'strong' ELSE 'maximum' END AS strength, count(*) AS requests FROM n GROUP BY 1, 2",
        "straighten_plan": f"WITH {HORIZON} SELECT vec_id AS photo_id, round(angle, 6) AS angle, abs(angle) >= 0.45 AND abs(angle) <= 8 AND vec_id % 4 <> 0 AND vec_id % 5 <> 0 AS straightens FROM horizon",
        "screenshot_score": f"WITH {tiled(3)}, b AS (SELECT photo_id, px, px[1:72] AS top, px[73:456] AS middle, px[457:576] AS bottom FROM tiled), s AS (SELECT photo_id, round({_SOCIAL}, 6) AS social, round({_edges('px')}, 6) AS text_edge FROM b) SELECT photo_id, social, text_edge, social >= 34 OR ({_ASPECT} > 1.5 AND social >= 26) OR ({_ASPECT} > 1.75 AND social >= 22 AND text_edge >= 1.0) AS is_screenshot FROM s",
        "crop_rows": f"WITH {tiled(3)}, {STRATEGIES}, c AS (SELECT photo_id, strategy, px, floor(crop_top * 24)::INTEGER AS a, floor(crop_bottom * 24)::INTEGER AS b FROM tiled, strategies), k AS (SELECT *, CASE WHEN b - a >= 24 * 0.64 THEN px[a * 24 + 1:b * 24] ELSE px END AS kept FROM c) SELECT photo_id, strategy, len(kept) AS pixels, list_sum(kept)::BIGINT AS level_sum FROM k",
        "tile_grid": "WITH s AS (SELECT vec_id AS photo_id, 200 + vec_id % 13 * 50 AS h, 300 + vec_id % 7 * 90 AS w FROM embeddings), y AS (SELECT *, unnest(range(0, h, 224)) AS y FROM s), x AS (SELECT *, unnest(range(0, w, 224)) AS x FROM y) SELECT photo_id, count(*) AS tiles, sum((least(y + 256, h) - y) * (least(x + 256, w) - x))::BIGINT AS pixels, max(y) AS last_y FROM x GROUP BY 1",
        "overlap_add": f"WITH {SMALL}, y AS (SELECT photo_id, px, unnest([0, 3, 6]) AS y FROM small), x AS (SELECT *, unnest([0, 3, 6]) AS x FROM y), t AS (SELECT *, least(y + 4, 8) - y AS h, least(x + 4, 8) - x AS w FROM x), c AS (SELECT *, unnest(range(h * w)) AS k FROM t), p AS (SELECT photo_id, y + k // w AS oy, x + k % w AS ox, px[(y + k // w) * 8 + x + k % w + 1] + y + x AS v, ({_RAMP('k // w', 'h')}) * ({_RAMP('k % w', 'w')}) AS wt FROM c), s AS (SELECT photo_id, oy, ox, floor(round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, sum(v * wt) / greatest(sum(wt), 1e-4::DOUBLE))), 6))::INTEGER AS value FROM p GROUP BY 1, 2, 3) SELECT photo_id, count(*) AS pixels, sum(value)::BIGINT AS level_sum, max(value)::BIGINT AS largest FROM s GROUP BY 1",
        "encode_decode": f"WITH {SMALL} SELECT photo_id, ['zero_one', 'minus_one_one', 'zero_255'][photo_id % 3 + 1] AS kind, round(list_sum([CASE photo_id % 3 WHEN 1 THEN q / 127.5::DOUBLE - 1.0 WHEN 2 THEN q::DOUBLE ELSE q / 255.0::DOUBLE END FOR q IN px]), 4) AS coded_sum, true AS within_one FROM small",
        "provider_choice": "WITH c AS (SELECT [q FOR q IN [CASE WHEN c_custkey % 7 = 0 THEN 'CUDAExecutionProvider' END, CASE WHEN c_custkey % 3 = 0 THEN 'DmlExecutionProvider' END, CASE WHEN c_custkey % 2 = 0 THEN 'CPUExecutionProvider' END] IF q IS NOT NULL] AS u FROM customer) SELECT coalesce(u[1], 'none') AS provider, len(u) AS usable, count(*) AS machines FROM c GROUP BY 1, 2",
    }


def _needed() -> str:
    warned = "(photo_id % 23 = 0 OR compression_pooled > 20 OR blur < 80 OR dark_35 > 0.18 OR light_248 > 0.08)"
    return f"(len({REASONS}) > 0 OR photo_id % 13 = 0 OR photo_id % 7 = 0 OR quality_score < 38 OR safety < 38 OR (face_count > 0 AND 1.0::DOUBLE - (photo_id % 50) / 100.0::DOUBLE < 0.72) OR photo_id % 19 = 0 OR ({warned} AND photo_id % 2 = 0))"


def _lint() -> str:
    return listed(
        ("capability = 'translate'", "unsupported capability"), ("filename = ''", "missing filename"), ("filename = '../m.onnx'", "unsafe filename path"), ("filename = 'models/m.onnx' AND actual_size IS NULL", "missing model file"),
        ("checked AND size <> 0 AND actual_size <> size", "file size mismatch"), ("checked AND no_hash", "SHA-256 is required"), ("checked AND NOT no_hash AND NOT hash_fits", "SHA-256 mismatch"), ("checked AND len(providers) = 0", "provider list is required"),
        ("checked AND list_contains(providers, 'OtherProvider')", "unsupported providers"), ("checked AND NOT list_contains(providers, 'CPUExecutionProvider')", "CPU fallback is required"),
    )
