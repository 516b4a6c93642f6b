"""The ten queries by name, and the SQL of those that DuckDB can express."""

from . import byte_bpe, html_text, language_id, media, mixing, quality, simhash, substring_dedup, vafile, warc

QUERIES = byte_bpe.QUERIES | html_text.QUERIES | language_id.QUERIES | media.QUERIES | mixing.QUERIES | quality.QUERIES | simhash.QUERIES | substring_dedup.QUERIES | vafile.QUERIES | warc.QUERIES
ORACLE: dict[str, str] = substring_dedup.ORACLE | vafile.ORACLE | warc.ORACLE
