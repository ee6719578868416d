"""Named SQL steps (DuckDB dialect) the oracles are put together from."""

from __future__ import annotations

from hostlens.functions import lists
from hostlens.functions.suffix import default_rules
from hostlens.sources.fixtures import STRESS_HOSTS

PRIME = 2**31 - 1


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def text_set(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def r9(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-12::DOUBLE, 9) + 0 AS {name}"


def word(text: str, at: int = 0) -> str:
    return f"('0x' || substr(md5({text}), {8 * at + 1}, 8))::BIGINT"


def words(key: str) -> str:
    return ", ".join(f"{word(key, i)} % {PRIME} AS {name}" for i, name in enumerate("xy"))


DRAWN = f"((x * a + b) % {PRIME} * y + x * c) % {PRIME} / {PRIME}.0::DOUBLE"


def host_steps(source: str, keep: str) -> str:
    """Hostname of `url` in small steps."""
    return f"""
    SELECT {keep}, rtrim(CASE WHEN starts_with(h5, 'www.') THEN substr(h5, 5) ELSE h5 END, '.') AS hostname
    FROM (SELECT *, lower(CASE WHEN starts_with(h4, '[') THEN ltrim(split_part(h4, ']', 1), '[')
                               ELSE split_part(h4, ':', 1) END) AS h5
    FROM (SELECT *, string_split(h3, '@')[-1] AS h4
    FROM (SELECT *, regexp_extract(h2, '^[^/?#]*') AS h3
    FROM (SELECT *, regexp_replace(h1, '^[a-z][a-z0-9+.\\-]*://', '', 'i') AS h2
    FROM (SELECT *, regexp_replace(coalesce(url, ''), '^\\s+|\\s+$', '', 'g') AS h1 FROM {source})))))"""


def entropy(text: str) -> str:
    chars = f"string_split({text}, '')"
    return f"""CASE WHEN {text} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct({chars}),
      lambda c: -(len(list_filter({chars}, lambda x: x = c)) / length({text}))
                * log2(len(list_filter({chars}, lambda x: x = c)) / length({text})))) END"""


def digits(text: str) -> str:
    return f"length(regexp_replace({text}, '[^0-9]', '', 'g'))"


def share(part: str, text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0.0 ELSE {part} / length({text}) END"


def keywords(text: str) -> str:
    return f"len(list_filter({text_list(lists.SUSPICIOUS_KEYWORDS)}, lambda w: contains({text}, w)))"


BRANDS = "[" + ", ".join(
    f"{{'b': '{b}', 'd': {text_list(d)}, 'w': {'true' if b in lists.WHOLE_TOKEN_BRANDS else 'false'}}}"
    for b, d in lists.BRAND_DOMAINS.items()
) + "]"


def _rules() -> str:
    rules = default_rules()
    rows = [("exact", r) for r in rules.exact] + [("wild", r) for r in rules.wildcard]
    rows += [("except", r) for r in rules.exception]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in sorted(rows)) + ") t(kind, rule)"


PARTS = """
  SELECT hostname, is_ip, suffix, domain_label, subdomain, registered_domain,
    CASE WHEN is_ip THEN ''
         WHEN list_contains({free}, registered_domain) AND subdomain <> '' THEN string_split(subdomain, '.')[-1]
         ELSE domain_label END AS effective_name
  FROM (
    SELECT hostname, is_ip,
      CASE WHEN is_ip THEN '' ELSE array_to_string(l[n - k + 1:n], '.') END AS suffix,
      CASE WHEN is_ip THEN hostname WHEN k = n THEN '' ELSE l[n - k] END AS domain_label,
      CASE WHEN is_ip OR n - k < 2 THEN '' ELSE array_to_string(l[1:n - k - 1], '.') END AS subdomain,
      CASE WHEN is_ip OR k = 0 OR k = n OR l[n - k] = '' THEN hostname
           ELSE array_to_string(l[n - k:n], '.') END AS registered_domain
    FROM (SELECT hostname, l, n, is_ip, CASE WHEN is_ip THEN 0 ELSE k END AS k FROM (
      SELECT hostname, any_value(l) AS l, any_value(n) AS n, any_value(is_ip) AS is_ip,
        coalesce(max(CASE WHEN t IN (SELECT rule FROM rules WHERE kind = 'except') THEN k - 1 END),
                 max(CASE WHEN t IN (SELECT rule FROM rules WHERE kind = 'exact')
                            OR (k > 1 AND b IN (SELECT rule FROM rules WHERE kind = 'wild'))
                            OR (k = 1 AND regexp_full_match(t, '[a-z][a-z]')
                                AND NOT regexp_full_match(t, 'aa|q[m-z]|x[a-z]|zz')
                                AND t NOT IN (SELECT rule FROM rules WHERE kind = 'wild')) THEN k END), 0) AS k
      FROM (SELECT *, array_to_string(l[n - k + 1:n], '.') AS t, array_to_string(l[n - k + 2:n], '.') AS b
            FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (
              SELECT hostname, string_split(hostname, '.') AS l, len(string_split(hostname, '.')) AS n,
                (regexp_full_match(hostname, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}')
                 AND len(list_filter(string_split(hostname, '.'), lambda o: TRY_CAST(o AS INT) > 255
                         OR (length(o) > 1 AND starts_with(o, '0')))) = 0)
                OR regexp_full_match(hostname, '([0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}|(([0-9a-f]{{1,4}}:)*[0-9a-f]{{1,4}})?::(([0-9a-f]{{1,4}}:)*[0-9a-f]{{1,4}})?')
                AS is_ip
              FROM hosts)))
      GROUP BY hostname)))""".format(free=text_list(lists.FREE_HOSTING_DOMAINS))

FEATURE_SQL = {
    "hostname_length": "length(hostname)",
    "num_labels": "CASE WHEN hostname = '' THEN 0 ELSE len(string_split(hostname, '.')) END",
    "num_subdomain_levels": "CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END",
    "num_digits": digits("hostname"),
    "digit_ratio": share(digits("hostname"), "hostname"),
    "num_hyphens": "len(string_split(hostname, '-')) - 1",
    "longest_label_length": "list_max(list_transform(string_split(hostname, '.'), lambda x: length(x)))",
    "domain_entropy": entropy("domain_label"),
    "vowel_ratio": share("length(regexp_replace(domain_label, '[^aeiou]', '', 'g'))", "domain_label"),
    "is_ip": "is_ip::INT",
    "is_punycode": "contains(hostname, 'xn--')::INT",
    "brand_impersonation": f"""(len(list_filter({BRANDS}, lambda b: NOT list_contains(b.d, registered_domain)
        AND CASE WHEN b.w THEN list_contains(regexp_split_to_array(hostname, '[.\\-]'), b.b)
                 ELSE contains(hostname, b.b) END)) > 0)::INT""",
    "suspicious_keyword_count": keywords("hostname"),
    "is_free_hosting": f"(registered_domain IN {text_set(lists.FREE_HOSTING_DOMAINS)})::INT",
    "tld_risky": f"(string_split(suffix, '.')[-1] IN {text_set(lists.RISKY_TLDS)})::INT",
    "name_length": "length(effective_name)",
    "name_entropy": entropy("effective_name"),
    "name_digit_ratio": share(digits("effective_name"), "effective_name"),
    "name_num_hyphens": "len(string_split(effective_name, '-')) - 1",
    "name_keyword_count": keywords("effective_name"),
    "name_brand_lookalike": f"""(len(list_filter(string_split(effective_name, '-'), lambda t: length(t) >= 5
        AND len(list_filter({BRANDS}, lambda b: length(b.b) >= 5 AND b.b <> t
            AND levenshtein(t, b.b) <= 2 AND NOT list_contains(b.d, registered_domain))) > 0)) > 0)::INT""",
    "name_homoglyph_brand": f"""(len(list_filter(string_split(effective_name, '-'), lambda t:
        len(list_filter({BRANDS}, lambda b: b.b <> t
            AND translate(replace(replace(t, 'rn', 'm'), 'vv', 'w'), '0135', 'oles') = b.b
            AND NOT list_contains(b.d, registered_domain))) > 0)) > 0)::INT""",
}
REAL_FEATURES = ("digit_ratio", "domain_entropy", "vowel_ratio", "name_entropy", "name_digit_ratio")


def feature_list(rounded: bool = True) -> str:
    out = []
    for f, sql in FEATURE_SQL.items():
        if f in REAL_FEATURES:
            out.append(r9(sql, f) if rounded else f"CAST({sql} AS DOUBLE) AS {f}")
        else:
            out.append(f"CAST({sql} AS INT) AS {f}")
    return ", ".join(out)


FOLD_STEPS = """
  {p}sizes AS (SELECT registered_domain AS g, count(*) AS n, sum(label)::BIGINT AS n_pos FROM {src} GROUP BY 1),
  {p}tot AS (SELECT sum(n)::BIGINT AS rows, count(*) AS groups FROM {p}sizes),
  {p}big AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM {p}sizes, {p}tot WHERE n * 100 >= rows),
  {p}placed AS (
    SELECT 0::BIGINT AS i, NULL::VARCHAR AS g, NULL::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
    UNION ALL
    SELECT b.i, b.g, (list_position(p.loads, list_min(p.loads)) - 1)::INT,
      list_transform(p.loads, lambda x, j: CASE WHEN j = list_position(p.loads, list_min(p.loads)) THEN x + b.n ELSE x END)
    FROM {p}placed p JOIN {p}big b ON b.i = p.i + 1),
  {p}level AS (SELECT loads, list_min(list_transform([1, 2, 3, 4, 5],
      lambda j: (rows - list_sum(loads) + list_sum(list_sort(loads)[1:j])) / j)) AS level
    FROM {p}placed, {p}tot WHERE i = (SELECT max(i) FROM {p}placed)),
  {p}lack AS (SELECT list_transform(loads, lambda x: greatest(level - x, 0.0)) AS lack FROM {p}level),
  {p}small AS (
    SELECT *, row_number() OVER (PARTITION BY n_pos, n, salt ORDER BY md5(g || '|42'), g) AS rn,
      count(*) OVER (PARTITION BY n_pos, n, salt) AS cnt
    FROM (SELECT s.*, """ + word("g || '|salt'") + """ % greatest(1, ceil(groups / 100000))::BIGINT AS salt
          FROM {p}sizes s, {p}tot WHERE n * 100 < rows)),
  {p}drawn AS (SELECT g, v - floor(v) AS u FROM (
    SELECT g, (rn - 0.5) / cnt + """ + word("n_pos || '|' || n || '|' || salt || '|42'") + """ / 4294967296.0 AS v FROM {p}small)),
  {p}fold AS (
    SELECT g, fold FROM {p}placed WHERE g IS NOT NULL
    UNION ALL
    SELECT g, len(list_filter([1, 2, 3, 4], lambda i:
      u >= list_sum(lack[1:i]) / nullif(list_sum(lack), 0)))::INT FROM {p}drawn, {p}lack)"""

# name -> (steps it needs, text); texts that define several steps start with their own names.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "urls": ((), """
  SELECT o_orderkey AS url_id,
    split_part('https://,http://,HTTPS://www.,,ftp://', ',', CAST(o_orderkey % 5 AS INT) + 1)
    || CASE WHEN o_orderkey % 41 = 0 THEN 'user:pw@' ELSE '' END
    || CASE WHEN o_orderkey % 97 = 0 THEN '192.168.0.' || CAST(o_custkey % 256 AS STRING)
       ELSE split_part(',mail.,login.mail.,,docs.,', ',', CAST(o_orderkey % 6 AS INT) + 1)
       || split_part('paypa1-verify,arnazon-support,chase-login,paypalsecure-verify,paypai-login,purchase-guide,pineapple-recipes,example,xn--bcher-kva,wiki,store,news', ',', CAST(o_orderkey % 12 AS INT) + 1)
       || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END || '.'
       || split_part('com,github.io,co.uk,xyz,web.app,net,org,online', ',', CAST(o_custkey % 8 AS INT) + 1) END
    || CASE WHEN o_orderkey % 11 = 0 THEN ':8080' ELSE '' END
    || split_part('/,,/login?x=1#top,?q=1,/a/b/c', ',', CAST(o_custkey % 5 AS INT) + 1) AS url,
    CASE WHEN o_orderkey % 12 < 5 OR o_custkey % 17 = 0 THEN 1 ELSE 0 END AS label
  FROM orders"""),
    "all_urls": (("urls",), """
  SELECT 'orders' AS src, url_id AS id, url FROM urls
  UNION ALL SELECT 'pages', page_id, url FROM pages"""),
    "stress": ((), "SELECT unnest(" + text_list(STRESS_HOSTS.split()) + ") AS hostname"),
    "named": (("all_urls",), host_steps("all_urls", "src, id, url")),
    "unamed": (("urls",), host_steps("urls", "url_id, url, label")),
    "hosts": (("named", "stress"), "SELECT hostname FROM named UNION SELECT hostname FROM stress"),
    "url_hosts": (("named",), "SELECT DISTINCT hostname FROM named"),
    "rules": ((), _rules()),
    "parts": (("hosts", "rules"), PARTS),
    "feats": (("parts",), "SELECT hostname, " + feature_list(rounded=False) + " FROM parts"),
    # Cleaning and merging.
    "by_url": (("unamed",), """
  SELECT url, any_value(hostname) AS hostname, count(*) AS n, arg_min(label, url_id) AS label
  FROM unamed GROUP BY url"""),
    "clean": (("by_url",), """
  SELECT hostname, min(label) AS label FROM by_url WHERE hostname <> ''
  GROUP BY hostname HAVING count(DISTINCT label) = 1"""),
    "ranked": (("unamed",), """
  SELECT hostname, min(url_id)::INT AS rank FROM unamed WHERE label = 0 AND hostname <> '' GROUP BY 1"""),
    "list_b": (("unamed", "parts"), """
  SELECT (min(url_id) + 1)::INT AS rank, registered_domain AS domain
  FROM unamed JOIN parts USING (hostname) WHERE hostname <> '' GROUP BY 2"""),
    "top": (("list_b",), "SELECT DISTINCT lower(domain) AS registered_domain FROM list_b WHERE rank <= 1000"),
    "stress_domains": (("stress", "parts"), "SELECT DISTINCT registered_domain FROM stress JOIN parts USING (hostname)"),
    "phish": (("clean",), "SELECT hostname FROM clean WHERE label = 1"),
    "benign_tag": (("ranked", "parts", "top", "phish", "stress_domains"), """
  SELECT hostname, registered_domain, rank,
    CASE WHEN NOT (suffix <> '' AND registered_domain <> hostname) THEN 1
         WHEN registered_domain NOT IN (FROM top) THEN 2
         WHEN hostname IN (FROM phish) THEN 3
         WHEN registered_domain IN (FROM stress_domains) THEN 4 ELSE 5 END AS gone
  FROM ranked JOIN parts USING (hostname)"""),
    "benign": (("benign_tag",), """
  SELECT hostname, registered_domain FROM benign_tag WHERE gone = 5
  QUALIFY row_number() OVER (PARTITION BY registered_domain ORDER BY rank, hostname) <= 20"""),
    "unioned": (("clean", "parts", "benign"), """
  SELECT hostname, registered_domain, label, 'phiusiil' AS source FROM clean JOIN parts USING (hostname)
  UNION ALL SELECT hostname, registered_domain, 0, 'umbrella' FROM benign"""),
    "merged": (("unioned",), """
  SELECT hostname, registered_domain, min(label)::INT AS label, min(source) AS source FROM unioned
  GROUP BY 1, 2 HAVING count(DISTINCT label) = 1"""),
    "folds": (("merged",), "*" + FOLD_STEPS.format(p="m_", src="merged")),
    "dataset": (("merged", "folds"), """
  SELECT hostname, registered_domain, label, source, fold,
    CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split
  FROM merged JOIN m_fold ON registered_domain = g"""),
    "train": (("dataset",), "SELECT * EXCLUDE (fold) FROM dataset WHERE split = 'train'"),
    "train_folds": (("train",), "*" + FOLD_STEPS.format(p="t_", src="train")),
    "folded": (("train", "train_folds", "feats"), """
  SELECT train.*, t_fold.fold, feats.* EXCLUDE (hostname)
  FROM train JOIN t_fold ON registered_domain = g JOIN feats ON feats.hostname = train.hostname"""),
    # Scored requests.
    "scored": (("unamed",), f"""
  SELECT request_id, timestamp, day, hostname, source, probability,
    CASE WHEN u < probability * (CASE WHEN extract(day FROM timestamp) > 20 THEN 0.5 ELSE 1.0 END)::DOUBLE
         THEN 1 ELSE 0 END AS label
  FROM (SELECT event_id, CAST(event_id AS STRING) AS request_id, ts AS timestamp, event_type AS source,
          (datediff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS day,
          value / (value + 50) AS probability,
          {word("CAST(event_id AS STRING)")} / 4294967296.0::DOUBLE AS u FROM events)
  JOIN unamed ON event_id = url_id"""),
    "held": (("scored",), f"""
  SELECT * EXCLUDE (w, n, rn), rn <= round(n * 0.2) AS is_reference FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY w, request_id) AS rn,
      count(*) OVER (PARTITION BY label) AS n
    FROM (SELECT *, {word("request_id || '|42'")} AS w FROM scored))"""),
    "hf": (("held", "feats"), "SELECT * FROM held JOIN feats USING (hostname)"),
    "ref": (("hf",), f"""
  SELECT * EXCLUDE (part) REPLACE (request_id || '-' || part AS request_id,
    CASE WHEN {word("request_id || '-' || part")} / 4294967296.0::DOUBLE
           < probability * (CASE WHEN extract(day FROM timestamp) > 20 THEN 0.5 ELSE 1.0 END)::DOUBLE
         THEN 1 ELSE 0 END AS label)
  FROM hf, range(20) t(part) WHERE is_reference"""),
    "traffic": (("hf",), "SELECT * FROM hf WHERE NOT is_reference"),
    "draws": ((), f"""
  SELECT d::INT AS draw, {word("'slope|' || d || '|42'")} % {PRIME - 1} + 1 AS a,
    {word("'shift|' || d || '|42'")} % {PRIME} AS b, {word("'mix|' || d || '|42'")} % {PRIME} AS c FROM range(200) t(d)"""),
    "sliced": (("ref", "draws"), f"""
  SELECT ref.*, draw AS slice FROM (
    SELECT request_id, draw, row_number() OVER (PARTITION BY draw ORDER BY u, request_id) AS rn FROM (
      SELECT request_id, draw, {DRAWN} AS u
      FROM (SELECT request_id, {words("request_id || '|42'")} FROM ref), draws))
  JOIN ref USING (request_id) WHERE rn <= 2000"""),
}

LONG = "UNPIVOT (SELECT {by}, " + ", ".join(
    f"round({f}::DOUBLE, 12) AS {f}" for f in lists.FEATURES
) + " FROM {src}) ON " + ", ".join(lists.FEATURES) + " INTO NAME feature VALUE value"

KS_GRID = """
  {p}cnt AS (SELECT {by}, feature, value, count(*) AS n FROM {p}long GROUP BY ALL),
  {p}ref AS (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY ALL),
  {p}values AS (SELECT DISTINCT feature, value FROM (SELECT feature, value FROM {p}cnt UNION ALL SELECT feature, value FROM {p}ref)),
  {p}grid AS (
    SELECT k.{by}, v.feature, v.value, coalesce(c.n, 0) AS n, coalesce(r.n, 0) AS rn
    FROM (SELECT DISTINCT {by} FROM {p}cnt) k CROSS JOIN {p}values v
    LEFT JOIN {p}cnt c ON c.{by} = k.{by} AND c.feature = v.feature AND c.value = v.value
    LEFT JOIN {p}ref r ON r.feature = v.feature AND r.value = v.value),
  {p}cum AS (
    SELECT {by}, feature, value, n, rn,
      sum(n) OVER (PARTITION BY {by}, feature ORDER BY value) AS cn, sum(n) OVER (PARTITION BY {by}, feature) AS an,
      sum(rn) OVER (PARTITION BY {by}, feature ORDER BY value) AS cr, sum(rn) OVER (PARTITION BY {by}, feature) AS ar
    FROM {p}grid)"""
BINARY = text_set(lists.BINARY_FEATURES)

# Trees on one feature: counts per value, three levels of best cuts, rates of the leaves.
STEPS["power_counts"] = (("folded",), f"""
  SELECT feature, model, value, count(*) FILTER (fold <> model) AS n, count(*) FILTER (fold <> model AND label = 1) AS pos,
    count(*) FILTER (fold = model) AS val_n, count(*) FILTER (fold = model AND label = 1) AS val_pos, 1 AS node
  FROM (UNPIVOT (SELECT fold, label, {", ".join(f"round({f}::DOUBLE, 12) AS {f}" for f in lists.FEATURES)} FROM folded)
        ON {", ".join(lists.FEATURES)} INTO NAME feature VALUE value), range(5) m(model)
  GROUP BY feature, model, value""")


def _impurity(n: str, pos: str) -> str:
    return f"CASE WHEN {n} > 0 THEN 2.0::DOUBLE * {pos} * ({n} - {pos}) / {n} ELSE 0 END"


def _grown(state: str) -> str:
    """One more level: each mixed node is cut where the two sides are purest, at the lowest value on a tie."""
    keep = "feature, model, value, n, pos, val_n, val_pos, node"
    return f"""
  SELECT {keep.replace(", node", "")},
    CASE WHEN all_pos > 0 AND all_pos < all_n AND cut IS NOT NULL THEN node * 2 + (value > cut)::INT ELSE node END AS node
  FROM (SELECT *, min(CASE WHEN impurity = least_impurity THEN middle END) OVER (PARTITION BY feature, model, node) AS cut
    FROM (SELECT *, min(impurity) OVER (PARTITION BY feature, model, node) AS least_impurity
      FROM (SELECT *, CASE WHEN n > 0 AND following IS NOT NULL THEN (value + following) / 2 END AS middle,
          CASE WHEN n > 0 AND following IS NOT NULL
               THEN round({_impurity("cum_n", "cum_pos")} + {_impurity("(all_n - cum_n)", "(all_pos - cum_pos)")}, 9) END AS impurity
        FROM (SELECT {keep}, (sum(n) OVER whole)::BIGINT AS all_n, (sum(pos) OVER whole)::BIGINT AS all_pos,
            (sum(n) OVER upto)::BIGINT AS cum_n, (sum(pos) OVER upto)::BIGINT AS cum_pos,
            min(CASE WHEN n > 0 THEN value END) OVER later AS following
          FROM {state} WINDOW whole AS (PARTITION BY feature, model, node),
            upto AS (PARTITION BY feature, model, node ORDER BY value ROWS UNBOUNDED PRECEDING),
            later AS (PARTITION BY feature, model, node ORDER BY value ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))))"""


STEPS["power_1"] = (("power_counts",), _grown("power_counts"))
STEPS["power_2"] = (("power_1",), _grown("power_1"))
STEPS["power_3"] = (("power_2",), _grown("power_2"))
STEPS["power"] = (("power_3",), """
  SELECT feature, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std FROM (
    SELECT feature, model, sum((vn - vp) * (above + vp / 2)) / nullif(sum(vp) * sum(vn - vp), 0) AS auc FROM (
      SELECT *, sum(vp) OVER (PARTITION BY feature, model ORDER BY rate DESC) - vp AS above FROM (
        SELECT feature, model, round(rate, 12) AS rate, sum(vn)::DOUBLE AS vn, sum(vp)::DOUBLE AS vp FROM (
          SELECT feature, model, node, sum(pos) / sum(n) AS rate, sum(val_n) AS vn, sum(val_pos) AS vp
          FROM power_3 GROUP BY ALL) GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1""")

STEPS["ref_long"] = (("ref",), LONG.format(by="request_id", src="ref"))
STEPS["day_long"] = (("traffic",), LONG.format(by="day", src="traffic"))
STEPS["slice_long"] = (("sliced",), LONG.format(by="slice", src="sliced"))
STEPS["day_grid"] = (("ref_long", "day_long"), "*" + KS_GRID.format(p="day_", by="day").replace("day_long", "day_long"))
STEPS["slice_grid"] = (("ref_long", "slice_long"), "*" + KS_GRID.format(p="slice_", by="slice"))
STEPS["day_scores"] = (("day_grid",), f"""
  SELECT day, feature, CASE WHEN feature IN {BINARY} THEN abs(sum(value * n) / sum(n) - sum(value * rn) / sum(rn))
    ELSE max(abs(cn / an - cr / ar)) END AS score
  FROM day_cum GROUP BY day, feature""")
# The slice against the rest of the reference.
STEPS["null_scores"] = (("slice_grid",), f"""
  SELECT slice, feature, CASE WHEN feature IN {BINARY}
    THEN abs(sum(value * n) / sum(n) - sum(value * (rn - n)) / sum(rn - n))
    ELSE max(abs(cn / an - (cr - cn) / (ar - an))) END AS score
  FROM slice_cum GROUP BY slice, feature""")
STEPS["thresholds"] = (("null_scores",), """
  SELECT feature, greatest(0.05::DOUBLE, quantile_cont(score, 0.99) * 1.1) AS threshold
  FROM null_scores GROUP BY feature""")


def perf(src: str, by: str) -> str:
    flagged = "probability >= 0.626::DOUBLE"
    return f"""
  SELECT {by},
    avg((NOT ({flagged}))::INT) AS share_safe,
    avg(({flagged} AND is_free_hosting <> 1)::INT) AS share_phishing,
    avg(({flagged} AND is_free_hosting = 1)::INT) AS share_review,
    avg(probability) AS mean_probability,
    sum(probability) FILTER ({flagged}) / nullif(count(*) FILTER ({flagged}), 0) AS est_precision,
    sum(probability) FILTER ({flagged}) / nullif(sum(probability), 0) AS est_recall,
    count(*) FILTER ({flagged} AND label = 1) / nullif(count(*) FILTER ({flagged}), 0) AS real_precision,
    count(*) FILTER ({flagged} AND label = 1) / nullif(count(*) FILTER (label = 1), 0) AS real_recall,
    count(*) AS n_requests, avg(label) AS true_phishing_share
  FROM {src} GROUP BY {by}"""


CHECKS = (
    "share_safe", "share_phishing", "share_review", "mean_probability",
    "est_precision", "est_recall", "real_precision", "real_recall",
)
STEPS["day_perf"] = (("traffic",), perf("traffic", "day"))
STEPS["slice_perf"] = (("sliced",), perf("sliced", "slice"))
STEPS["slice_checks"] = (("slice_perf",), "UNPIVOT (SELECT slice, " + ", ".join(CHECKS)
    + " FROM slice_perf) ON " + ", ".join(CHECKS) + " INTO NAME \"check\" VALUE value")
STEPS["limits"] = (("slice_checks",), """
  SELECT "check", avg(value) - 3 * stddev_samp(value) AS low, avg(value) + 3 * stddev_samp(value) AS high,
    avg(value) AS reference FROM slice_checks GROUP BY 1""")
STEPS["day_drift"] = (("day_scores", "thresholds"), "SELECT day, count(*) FILTER (score > threshold) AS n_drifting, "
    "coalesce(string_agg(feature, ', ' ORDER BY list_position(" + text_list(lists.FEATURES)
    + ", feature)) FILTER (score > threshold), '') AS drifting_features FROM day_scores JOIN thresholds USING (feature) GROUP BY day")
# Positives of the rows with one score: a binomial number, by inversion of one uniform per draw.
STEPS["binomials"] = (("traffic",), """
  WITH scores AS (SELECT *, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE 9 * sqrt(n * p * (1 - p)) + 20 END AS reach
    FROM (SELECT day, probability AS p, count(*) AS n, min(request_id) AS key FROM traffic GROUP BY ALL)),
  hits AS (SELECT *, unnest(range(lo, greatest(least(ceil(n * p + reach)::BIGINT, n), lo) + 1)) AS k FROM
    (SELECT *, greatest(floor(n * p - reach)::BIGINT, 0) AS lo FROM scores)),
  logs AS (SELECT *, sum(CASE WHEN k = lo THEN 0 ELSE ln((n - k + 1) / k) + ln(p / (1 - p)) END)
    OVER (PARTITION BY day, p ORDER BY k) AS l FROM hits),
  weights AS (SELECT *, exp(l - max(l) OVER (PARTITION BY day, p)) AS w FROM logs)
  SELECT day, p, n, key, k, lo, sum(w) OVER (PARTITION BY day, p ORDER BY k DESC) / sum(w) OVER (PARTITION BY day, p) AS tail
  FROM weights""")
STEPS["interval"] = (("binomials", "draws"), f"""
  SELECT day, quantile_cont(p, 0.025) AS est_precision_low, quantile_cont(p, 0.975) AS est_precision_high,
    quantile_cont(r, 0.025) AS est_recall_low, quantile_cont(r, 0.975) AS est_recall_high
  FROM (SELECT day, draw, sum(hits) FILTER (f) / greatest(sum(n) FILTER (f), 1) AS p,
          coalesce(sum(hits) FILTER (f), 0) / greatest(sum(hits), 1) AS r
        FROM (SELECT day, draw, any_value(n) AS n, p >= 0.626::DOUBLE AS f,
                any_value(lo) + count(*) FILTER (k > lo AND tail > u) AS hits
              FROM (SELECT *, {DRAWN} AS u FROM (SELECT *, {words("key || '|42'")} FROM binomials), draws)
              GROUP BY day, p, draw)
        GROUP BY day, draw) GROUP BY day""")
STEPS["daily"] = (("day_perf", "day_drift", "interval"), """
  SELECT * FROM day_perf JOIN day_drift USING (day) JOIN interval USING (day)""")
STEPS["alerts"] = (("daily", "limits"), "WITH long AS (UNPIVOT (SELECT day, " + ", ".join(CHECKS)
    + " FROM daily) ON " + ", ".join(CHECKS) + """ INTO NAME "check" VALUE value)
  SELECT day, "check", value, CASE WHEN value < low THEN low ELSE high END AS "limit",
    CASE WHEN value < low THEN 'below' ELSE 'above' END AS direction
  FROM long JOIN limits USING ("check") WHERE value < low OR value > high
  UNION ALL
  SELECT day, 'drifting_features', n_drifting::DOUBLE, 2.0::DOUBLE, 'above' FROM daily WHERE n_drifting > 2""")
STEPS["scenarios"] = ((), """
  SELECT * FROM (VALUES (1, 10, 'normal'), (11, 20, 'free-hosting campaign'),
    (21, 30, 'clean-looking phishing')) t(lo, hi, scenario)""")


def oracle(final: str, *needs: str, instead: dict | None = None) -> str:
    """The final statement after all the steps it needs, in order; some may be other ones `instead`."""
    done: list[str] = []
    steps = STEPS | (instead or {})

    def add(name: str) -> None:
        if name not in done:
            for need in steps[name][0]:
                add(need)
            done.append(name)

    for name in needs:
        add(name)
    texts = []
    for name in done:
        text = steps[name][1]
        texts.append(text[1:] if text.startswith("*") else f"{name} AS MATERIALIZED ({text})")
    return ("WITH RECURSIVE " + ",\n".join(texts) + "\n" if texts else "") + final
