"""op11: importance resampling of all documents towards the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import with_row
from paperloom.llm.resample import ranked
from paperloom.session import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_row(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked(rows, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by halves of bytes (polynomial 0xEDB88320, reflected), once for each word.
ORACLE = r"""
WITH RECURSIVE sixteen(i, c, k) AS (
  SELECT i, CAST(i AS UBIGINT), 0 FROM (SELECT unnest(range(16)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM sixteen WHERE k < 4),
tab AS (SELECT list(c ORDER BY i) AS t FROM sixteen WHERE k = 4),
low AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
counted AS (SELECT side, id, x AS word, count(*) AS n FROM (SELECT side, id, unnest(w) AS x FROM low) GROUP BY ALL),
crc AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(h) // 2 + 1), lambda i: [
      CAST(strpos('0123456789ABCDEF', h[2 * i]) - 1 AS UBIGINT), CAST(strpos('0123456789ABCDEF', h[2 * i - 1]) - 1 AS UBIGINT)]))),
    lambda c, x: xor(c >> 4, t[CAST(xor(c & 15, x) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted), tab),
sums AS (SELECT bucket, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM counted JOIN crc USING (word) GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g FROM sums, totals),
weights AS (SELECT id, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN crc USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || CAST(id AS VARCHAR)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM low LEFT JOIN weights USING (id) WHERE side = 0),
places AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (id)
"""
