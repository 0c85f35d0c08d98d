"""Queries over swatches and colours."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..operators import colors, options
from ..session import staged
from . import sqltext as d
from .registry import cte, query

IMAGES = r"!\[([^\]]*)\]\(([^\)]+)\)"
cte(
    "raw_lines",
    """SELECT page_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
FROM (SELECT page_id, string_split(markdown, chr(10)) AS ls FROM detail_pages) p""",
    "detail_pages",
)
cte(
    "image_rows",
    f"""
SELECT l.page_id, l.line_no, place, image, alt || ' ' || context AS context, lower(alt || ' ' || context) AS low FROM (
  SELECT page_id, line_no, unnest({d.rx_all('line', IMAGES, 2)}) AS image, unnest({d.rx_all('line', IMAGES, 1)}) AS alt,
    generate_subscripts({d.rx_all('line', IMAGES, 1)}, 1) - 1 AS place FROM raw_lines) l
JOIN (SELECT a.page_id, a.line_no, string_agg(b.line, ' ' ORDER BY b.line_no) AS context FROM raw_lines a
  JOIN raw_lines b ON b.page_id = a.page_id AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2
  WHERE contains(a.line, '![') GROUP BY a.page_id, a.line_no) c ON c.page_id = l.page_id AND c.line_no = l.line_no""",
    "raw_lines",
)
N_WORDS, N_NAMES = d.n_contained("low", lex.SWATCH_WORDS), d.n_contained("low", lex.COLOUR_WORDS)
cte(
    "swatch_rows",
    f"""
SELECT page_id, CAST(line_no AS INT) AS line_no, CAST(place AS INT) AS place, image, context, least(confidence, 1.0) AS confidence, reason FROM (
  SELECT page_id, line_no, place, image, context,
    CASE WHEN nw > 0 THEN least(0.4::DOUBLE, nw * 0.2::DOUBLE) ELSE 0.0 END + CASE WHEN by_file THEN 0.25::DOUBLE ELSE 0.0 END
    + CASE WHEN nn >= 2 THEN 0.3::DOUBLE WHEN nn = 1 THEN 0.1 ELSE 0.0 END
    + CASE WHEN strong THEN 0.35::DOUBLE ELSE 0.0 END AS confidence,
    concat_ws(' + ', CASE WHEN nw > 0 THEN 'color_keywords(' || nw || ')' END, CASE WHEN by_file THEN 'filename_pattern' END,
      CASE WHEN nn >= 2 THEN 'color_names(' || nn || ')' WHEN nn = 1 THEN 'color_name(1)' END,
      CASE WHEN strong THEN 'strong_phrase' END) AS reason
  FROM (SELECT *, {N_WORDS} AS nw, {N_NAMES} AS nn, {d.any_rx('lower(image)', lex.SWATCH_FILE_PATTERNS)} AS by_file,
      {d.any_contained('low', lex.STRONG_SWATCH_PHRASES)} AS strong FROM image_rows) a) b
WHERE confidence >= 0.3""",
    "image_rows",
)


@query("swatch_candidates", "SELECT * FROM swatch_rows", "swatch_rows")
def _(t):
    return colors.swatch_candidates(t.detail_pages())


cte(
    "cluster_rows",
    f"""
SELECT i.page_id, CAST(i.line_no AS INT) AS line_no, CAST(i.place AS INT) AS place, i.image,
  CAST(0.6 AS DOUBLE) AS confidence, 'image_cluster(' || g.n || '_images)' AS reason
FROM image_rows i JOIN (
  SELECT g.page_id, g.first_line, g.last_line, g.n FROM (
    SELECT page_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM (
      SELECT page_id, line_no, line_no - row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS island
      FROM raw_lines WHERE {d.has_rx('line', IMAGES)}) x GROUP BY page_id, island HAVING count(*) >= 3) g
  JOIN raw_lines l ON l.page_id = g.page_id AND l.line_no BETWEEN g.first_line - 3 AND g.last_line + 2
  GROUP BY ALL HAVING {d.any_contained("lower(string_agg(l.line, ' ' ORDER BY l.line_no))", lex.SWATCH_WORDS)}) g
ON g.page_id = i.page_id AND i.line_no BETWEEN g.first_line AND g.last_line""",
    "image_rows raw_lines",
)


@query("image_clusters", "SELECT * FROM cluster_rows", "cluster_rows")
def _(t):
    return colors.image_clusters(t.detail_pages())


cte(
    "file_rows",
    f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_no, place) - 1 AS INT) AS line_no, 0 AS place, image,
  CAST(0.5 AS DOUBLE) AS confidence, 'strong_filename' AS reason FROM image_rows
WHERE {d.any_rx('lower(image)', lex.STRONG_FILE_PATTERNS)}""",
    "image_rows",
)
cte(
    "all_swatches",
    """
SELECT page_id, image, confidence, reason, stage, line_no, place FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, image
    ORDER BY (stage < 2) DESC, confidence DESC, stage, line_no, place) AS rank FROM (
    SELECT page_id, line_no, place, image, confidence, reason, 0 AS stage FROM swatch_rows
    UNION ALL SELECT *, 1 FROM cluster_rows UNION ALL SELECT *, 2 FROM file_rows) u) r WHERE rank = 1""",
    "swatch_rows cluster_rows file_rows",
)


@query("swatches", "SELECT * FROM all_swatches", "all_swatches")
def _(t):
    return colors.swatches(t.detail_pages())


cte(
    "best_swatches",
    """SELECT page_id, image, confidence, reason FROM (SELECT *, row_number() OVER (PARTITION BY page_id
  ORDER BY confidence DESC, stage, line_no, place) AS rank FROM all_swatches WHERE confidence >= 0.5) r WHERE rank = 1""",
    "all_swatches",
)


@query("best_swatch", "SELECT * FROM best_swatches", "best_swatches")
def _(t):
    return colors.best_swatch(t.detail_pages())


@query(
    "nearby_options",
    f"""
SELECT page_id, line_no, place, image, CAST(rank AS INT) AS rank, option FROM (
  SELECT page_id, line_no, place, image, generate_subscripts(items, 1) - 1 AS rank, unnest(items) AS option FROM (
    SELECT page_id, line_no, place, image, list_filter(flatten(list_transform(
      list_filter(regexp_split_to_array(context, '[.!?]'), lambda s: {d.any_contained('lower(s)', lex.CHOICE_WORDS)}
        AND contains(s, ':')), lambda s: list_transform(string_split(string_split(s, ':')[-1], ','),
        lambda x: {d.strip('x')}))), lambda x: length(x) < 30) AS items FROM swatch_rows) a) b""",
    "swatch_rows",
)
def _(t):
    return colors.nearby_options(colors.swatch_candidates(t.detail_pages()))


# ------------------------------------------------------------------ dominant colours
#: Steps of the check, more than the given tables need until no centre moves.
ITERATIONS = 20
cte(
    "weights",
    "SELECT image_id, r, g, b, r + g + b AS light, count(*) AS n FROM pixels GROUP BY image_id, r, g, b",
    "pixels",
)


def _variance(c):
    return f"(sum({c} * {c} * n)::DOUBLE / sum(n)::DOUBLE - (sum({c} * n)::DOUBLE / sum(n)::DOUBLE) * (sum({c} * n)::DOUBLE / sum(n)::DOUBLE))"


cte(
    "image_stats",
    f"""
SELECT w.image_id, low, high, CASE WHEN variance > 2000 THEN 12 WHEN variance > 1000 THEN 8 ELSE 6 END AS k FROM (
  SELECT image_id, ({_variance('r')} + {_variance('g')} + {_variance('b')}) / 3 AS variance FROM weights GROUP BY image_id) w
JOIN (SELECT image_id, round(quantile_cont(r + g + b, 0.05), 6) AS low, round(quantile_cont(r + g + b, 0.95), 6) AS high
  FROM pixels GROUP BY image_id) q ON q.image_id = w.image_id""",
    "weights pixels",
)
cte(
    "trimmed",
    """
SELECT image_id, r, g, b, n, CAST(least((light - darkest) * k // greatest(brightest - darkest, 1), k - 1) AS INT) AS cluster
FROM (SELECT w.*, k, min(light) OVER (PARTITION BY w.image_id) AS darkest, max(light) OVER (PARTITION BY w.image_id) AS brightest
  FROM weights w JOIN image_stats s ON s.image_id = w.image_id WHERE light BETWEEN low AND high) x""",
    "weights image_stats",
)


def _means(source):
    mean = lambda c: f"sum({c} * n)::DOUBLE / sum(n) AS {c}"
    return f"SELECT image_id, cluster, {mean('r')}, {mean('g')}, {mean('b')}, sum(n) AS n FROM {source} GROUP BY image_id, cluster"


cte("centres_0", _means("trimmed"), "trimmed")
for _i in range(ITERATIONS):
    cte(
        f"assigned_{_i}",
        f"""SELECT image_id, r, g, b, n, cluster FROM (SELECT t.image_id, t.r, t.g, t.b, t.n, c.cluster,
  row_number() OVER (PARTITION BY t.image_id, t.r, t.g, t.b ORDER BY
    (t.r - c.r) * (t.r - c.r) + (t.g - c.g) * (t.g - c.g) + (t.b - c.b) * (t.b - c.b), c.cluster) AS rank
  FROM trimmed t JOIN centres_{_i} c ON c.image_id = t.image_id) x WHERE rank = 1""",
        f"trimmed centres_{_i}",
    )
    cte(f"centres_{_i + 1}", _means(f"assigned_{_i}"), f"assigned_{_i}")
cte(
    "dominant",
    f"""SELECT image_id, cluster, CAST(floor(r) AS INT) AS r, CAST(floor(g) AS INT) AS g, CAST(floor(b) AS INT) AS b,
  CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) * 100 AS percentage, CAST(n AS BIGINT) AS cluster_size
FROM centres_{ITERATIONS}""",
    f"centres_{ITERATIONS}",
)


@query("dominant_colors", "SELECT * FROM dominant", "dominant")
def _(t):
    return colors.dominant_colors(t.pixels())


SNAP = "CAST(least(greatest(round_even({c} / 5.0::DOUBLE, 0) * 5, 0), 255) AS INT)"
HEX = "('#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b))"
cte(
    "ranked_colors",
    f"""SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY percentage DESC, {HEX}) AS rank FROM (
  SELECT image_id, {SNAP.format(c='r')} AS r, {SNAP.format(c='g')} AS g, {SNAP.format(c='b')} AS b, percentage, cluster_size
  FROM dominant) s""",
    "dominant",
)
# Greedy merge, one colour per step: a colour joins the first kept one that is near.
cte(
    "merge_steps",
    """
SELECT image_id, 0::BIGINT AS step, []::STRUCT(r INT, g INT, b INT, percentage DOUBLE, cluster_size BIGINT)[] AS kept
FROM (SELECT DISTINCT image_id FROM ranked_colors) i
UNION ALL
SELECT m.image_id, m.step + 1, CASE
    WHEN len(list_filter(m.kept, lambda e: (e.r - c.r) * (e.r - c.r) + (e.g - c.g) * (e.g - c.g) + (e.b - c.b) * (e.b - c.b) < 900)) = 0
    THEN list_append(m.kept, {'r': c.r, 'g': c.g, 'b': c.b, 'percentage': c.percentage, 'cluster_size': c.cluster_size})
    ELSE list_transform(m.kept, lambda e, i: CASE WHEN i = list_position(list_transform(m.kept, lambda k:
        (k.r - c.r) * (k.r - c.r) + (k.g - c.g) * (k.g - c.g) + (k.b - c.b) * (k.b - c.b) < 900), true)
      THEN {'r': e.r, 'g': e.g, 'b': e.b, 'percentage': e.percentage + c.percentage,
        'cluster_size': e.cluster_size + c.cluster_size} ELSE e END) END
FROM merge_steps m JOIN ranked_colors c ON c.image_id = m.image_id AND c.rank = m.step + 1""",
    "ranked_colors",
)
cte(
    "palette",
    f"""SELECT image_id, r, g, b, percentage, cluster_size, {HEX} AS hex FROM (
  SELECT image_id, unnest(kept, recursive := true) FROM (
    SELECT image_id, arg_max(kept, step) AS kept FROM merge_steps GROUP BY image_id) x) y
WHERE percentage >= 2 AND NOT (r < 10 AND g < 10 AND b < 10) AND NOT (r > 245 AND g > 245 AND b > 245)""",
    "merge_steps",
)


@query("clean_palette", "SELECT * FROM palette", "palette", recursive=True)
def _(t):
    return colors.clean_palette(colors.dominant_colors(t.pixels()))


BOXES = ", ".join(
    f"({i}, {d.q(n)}, {lo[0]}, {lo[1]}, {lo[2]}, {hi[0]}, {hi[1]}, {hi[2]})" for i, (n, lo, hi) in enumerate(lex.COLOUR_BOXES)
)


def named_sql(source: str, keys: str, fallback: str) -> str:
    return f"""
SELECT c.* EXCLUDE (rough), coalesce(n.name, c.rough) AS name, CASE WHEN n.name IS NULL THEN 0.3::DOUBLE ELSE 0.9 END AS confidence
FROM (SELECT *, {HEX} AS hex, {HEX if fallback == 'hex' else fallback} AS rough FROM {source}) c LEFT JOIN (
  SELECT {keys}, name FROM (
    SELECT {keys}, name, dist, row_number() OVER (PARTITION BY {keys} ORDER BY dist, rule) AS rank FROM (
      SELECT {keys}, rule, name, (r - (r1 + r2) // 2) * (r - (r1 + r2) // 2) + (g - (g1 + g2) // 2) * (g - (g1 + g2) // 2)
        + (b - (b1 + b2) // 2) * (b - (b1 + b2) // 2) AS dist
      FROM {source} JOIN (VALUES {BOXES}) x(rule, name, r1, g1, b1, r2, g2, b2)
        ON r BETWEEN r1 AND r2 AND g BETWEEN g1 AND g2 AND b BETWEEN b1 AND b2) h) k
  WHERE rank = 1 AND dist < 2500) n ON {' AND '.join(f'n.{k} = c.{k}' for k in keys.split(', '))}"""


cte("named_palette", named_sql("(SELECT * EXCLUDE (hex) FROM palette)", "image_id, r, g, b", "hex"), "palette")
ROUGH = """CASE WHEN greatest(r, g, b) - least(r, g, b) < 30 THEN CASE WHEN (r + g + b) // 3 < 50 THEN 'Dark Gray'
    WHEN (r + g + b) // 3 < 100 THEN 'Medium Gray' WHEN (r + g + b) // 3 < 180 THEN 'Light Gray' ELSE 'Off-White' END
  WHEN r > g AND g > b AND r - b > 40 THEN CASE WHEN r < 100 THEN 'Dark Brown' WHEN r < 150 THEN 'Medium Brown'
    ELSE 'Light Brown' END
  WHEN r > g AND r > b THEN 'Red Tone' WHEN g > r AND g > b THEN 'Green Tone' WHEN b > r AND b > g THEN 'Blue Tone'
  ELSE 'Custom Color' END"""


@query("name_colors", named_sql("pixels", "vec_id", "hex"), "pixels")
def _(t):
    return colors.name_colors(t.pixels())


@query("name_colors_descriptive", named_sql("pixels", "vec_id", ROUGH), "pixels")
def _(t):
    return colors.name_colors(t.pixels(), "descriptive")


cte("named_pixels", named_sql("pixels", "vec_id", ROUGH), "pixels")
FAMILY = d.cases([(d.any_contained("lower(name)", w), d.q(f)) for f, w in lex.FAMILY_WORDS], "'Other'")


@query(
    "color_families",
    f"SELECT {FAMILY} AS family, count(*) AS n_colors, count(DISTINCT name) AS n_names FROM named_pixels GROUP BY 1",
    "named_pixels",
)
def _(t):
    return colors.color_families(colors.name_colors(t.pixels(), "descriptive"))


HINTS = ", ".join(f"CASE WHEN contains(lower(label), {d.q(n)}) THEN {d.q(n)} END" for n, _, _ in lex.COLOUR_BOXES)


@query(
    "color_hints",
    f"SELECT page_id, category, category_pos, pos, label, price, image, concat_ws(',', {HINTS}) AS color_hints FROM dc_rows",
    "dc_rows",
)
def _(t):
    hinted = colors.color_hints(options.configurator_options(t.detail_pages()))
    return hinted.withColumn("color_hints", F.array_join("color_hints", ",")).drop("few_options")


# A page's swatch image stands for one of the ten pixel groups.
IMAGE_NO = "length(image) % 10"


def page_palettes(t):
    swatch = staged(colors.best_swatch(t.detail_pages()).select("page_id", "image"), "page-swatches")
    named = colors.name_colors(colors.clean_palette(colors.dominant_colors(t.pixels())), "descriptive")
    images = swatch.select("image", F.expr(IMAGE_NO).cast("int").alias("image_id")).distinct()
    return swatch, images.join(named, "image_id").drop("image_id")


cte("rough_palette", named_sql("(SELECT * EXCLUDE (hex) FROM palette)", "image_id, r, g, b", ROUGH), "palette")
cte(
    "page_colors",
    f"""SELECT s.page_id, s.image, count(*) OVER (PARTITION BY s.image, p.hex) AS n_pages, p.* EXCLUDE (image_id)
FROM best_swatches s JOIN rough_palette p ON p.image_id = {IMAGE_NO.replace('image', 's.image')}""",
    "best_swatches rough_palette",
)


@query("colors_by_image", "SELECT * FROM page_colors", "page_colors", recursive=True)
def _(t):
    return colors.colors_by_image(*page_palettes(t))


@query(
    "color_reuse",
    """SELECT count(*) AS n_pages, count(DISTINCT image) AS n_images, count(*) - count(DISTINCT image) AS cache_hits
FROM best_swatches""",
    "best_swatches",
)
def _(t):
    return colors.reuse_statistics(colors.best_swatch(t.detail_pages()))


@query(
    "match_option_colors",
    f"""
SELECT o.page_id, o.category, o.category_pos, o.pos, o.label, o.price, o.image, h.hex_color,
  CASE WHEN h.hex_color IS NOT NULL THEN coalesce(nullif(o.image, '') || ' | ', '') || h.hex_color END AS reference
FROM detail_merged o LEFT JOIN (
  SELECT o.page_id, o.category, o.pos, arg_max(l.hex, l.rank) AS hex_color FROM (
    SELECT o.page_id, o.category, o.pos, arg_min(lower(c.name), c.rank) AS name FROM detail_merged o
    JOIN (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY percentage DESC, hex) AS rank FROM page_colors) c
      ON c.page_id = o.page_id AND {d.any_contained('lower(o.category)', lex.COLOUR_CATEGORY_WORDS)}
      AND (contains(lower(o.label), lower(c.name)) OR contains(lower(c.name), lower(o.label)))
    GROUP BY o.page_id, o.category, o.pos) o
  JOIN (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY percentage DESC, hex) AS rank FROM page_colors) l
    ON l.page_id = o.page_id AND lower(l.name) = o.name
  GROUP BY o.page_id, o.category, o.pos) h
ON h.page_id = o.page_id AND h.category = o.category AND h.pos = o.pos""",
    "detail_merged page_colors",
    recursive=True,
)
def _(t):
    named = colors.colors_by_image(*page_palettes(t))
    return colors.match_option_colors(options.merge_options(options.option_rows(t.detail_pages())), named)
