"""What SQL can express of the training-data queries, for DuckDB."""

from __future__ import annotations

from millrace.llm import quality_rules
from millrace.llm.decontamination import AGREE, MASKS, RUN

BLANK = r"\x20\x09-\x0D"


def url_filter(rules: tuple[tuple[str, str], ...]) -> str:
    listed = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules)
    return rf"""
WITH cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
parts AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical
  FROM cut),
listed AS (
  SELECT DISTINCT canonical FROM parts
  WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules (verdict, rule) AS (VALUES {listed}),
fitting AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN (SELECT *, split_part(rule, '/', 1) AS domain, substr(rule, strpos(rule, '/')) AS start FROM rules) r
    ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.start)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p
LEFT JOIN fitting f ON p.host = f.host AND p.path = f.path
LEFT JOIN listed l ON p.canonical = l.canonical
"""


def quality_by_host() -> str:
    q = quality_rules
    rate = {r: f"avg(f_{r}::INT)" for r in q.RULES}
    least, most = q.STRENGTH
    prior = ", ".join(
        f"avg(r_{r}) AS m_{r}, CASE WHEN var_pop(r_{r}) > 0 THEN "
        f"least(greatest(avg(r_{r}) * (1 - avg(r_{r})) / var_pop(r_{r}) - 1, {least}), {most}) ELSE {most} END AS k_{r}"
        for r in q.RULES
    )
    shrunk = ", ".join(f"(n_docs * r_{r} + m_{r} * k_{r}) / (n_docs + k_{r})" for r in q.RULES)
    return rf"""
WITH made AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[{BLANK}]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{BLANK}]')) AS lines
  FROM documents),
windows AS (
  SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM made WHERE len(words) > 3)),
often AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, a, b, c) > 1),
covered AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY row),
measured AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM made LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS f_base,
         100 * n_symbols > {q.MOST_SYMBOLS} * n_words AS f_symbols,
         100 * n_dup_lines > {q.MOST_DUP_LINES} * n_lines AS f_dup_lines
  FROM measured),
hosts AS (
  SELECT source, count(*) AS n_docs, {", ".join(f"{v} AS r_{r}" for r, v in rate.items())} FROM judged GROUP BY source),
verdicts AS (
  SELECT source, greatest({shrunk}) < {q.HOST_MOST} AS host_kept FROM hosts, (SELECT {prior} FROM hosts) priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
       NOT (f_base OR f_symbols OR f_dup_lines) AND host_kept AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


def decontamination_pairs() -> str:
    def words(table: str, key: str) -> str:
        plain = rf"regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}{BLANK}]+', '', 'g')"
        return (
            f"SELECT row_number() OVER () AS row, {key}, "
            f"list_filter(regexp_split_to_array({plain}, '[{BLANK}]+'), lambda w: w <> '') AS words FROM {table}"
        )

    def seeds(table: str) -> str:
        return " UNION ALL ".join(
            f"SELECT row, i, {number} AS mask, [{', '.join(f'words[i + {p}]' for p in mask)}] AS seen "
            f"FROM (SELECT row, words, unnest(range(1, len(words) - {mask[-1]} + 1)) AS i FROM {table} WHERE len(words) > {mask[-1]})"
            for number, mask in enumerate(MASKS)
        )

    same = "j + k + shift BETWEEN 1 AND len(doc) AND doc[j + k + shift] = item[j + k]"
    return rf"""
WITH docs AS ({words("documents", "doc_id")}),
items AS ({words("benchmark", "item_id")}),
doc_seeds AS ({seeds("docs")}),
item_seeds AS ({seeds("items")}),
aligned AS (
  SELECT DISTINCT d.row AS doc_row, i.row AS item_row, d.i - i.i AS shift
  FROM doc_seeds d JOIN item_seeds i ON d.mask = i.mask AND d.seen = i.seen),
laid AS (
  SELECT doc_id, item_id, shift, d.words AS doc, i.words AS item
  FROM aligned JOIN docs d ON d.row = doc_row JOIN items i ON i.row = item_row WHERE len(i.words) >= {RUN}),
counted AS (
  SELECT doc_id, item_id,
         (SELECT max(n) FROM (
            SELECT sum(CASE WHEN {same} THEN 1 ELSE 0 END) AS n
            FROM (SELECT unnest(range(1, len(item) - {RUN} + 2)) AS j), range({RUN}) t(k) GROUP BY j)) AS agreeing
  FROM laid)
SELECT doc_id, item_id, max(agreeing)::INT AS agreeing FROM counted
WHERE agreeing >= {AGREE} GROUP BY doc_id, item_id
"""
