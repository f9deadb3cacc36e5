"""Schemas of the tables that the engine keeps."""

from __future__ import annotations

CHUNK = "id long, text string, file_name string, file_path string, file_hash string, page int, block_type string, heading_path string, heading_level int, table_headers string, chunk_index int, category string, embedding array<float>"
FILES = "id long, file_name string, file_path string, file_hash string, file_type string, category string, chunk_count int, status string, created_at timestamp, updated_at timestamp"
BLOCKS = "file_hash string, file_name string, file_path string, page int, ord int, kind string, text string, style string, outline_lvl int, avg_size double, is_bold boolean, grid array<array<string>>, image binary, error string"
#: Where an image of a page comes from, as extractors may say beside a block.
PLACE = "xref int, width int, height int"
