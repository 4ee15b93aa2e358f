"""Schemas of the metadata tables; every operator reads and writes these."""

NODES = "unique_id string, name string, lookup_name string, resource_type string, package_name string, database string, schema_name string, language string, materialized string, path string, patch_path string, fqn array<string>, description string, tags array<string>, meta map<string,string>, config map<string,string>, raw_sql string, compiled_sql string, depends_on array<string>, source_name string, ord int"
COLUMNS = "unique_id string, model string, column string, ordinal int, data_type string, description string, tags array<string>, meta map<string,string>, config_meta map<string,string>"
EDGES = "parent_uid string, child_uid string"
EXPOSURES = "name string, type string, url string, description string, owner map<string,string>, depends_on array<string>"
TESTS = "attached_uid string, column string, test_name string, config map<string,string>, depends_on array<string>"
LINEAGE = "unique_id string, model string, column string, entry int, source_columns array<string>, transformation_type string, sql_expression string, union_branches array<string>"
FAILURES = "unique_id string, model string, error string"
STARS = "unique_id string, model string, source_model string, excepts array<string>"
SETTINGS = "scope string, unique_id string, column string, source_rank int, key string, value string"
GLOSSARY = "column string, description string"
INTROSPECTED = "relation string, column string, data_type string, index int, comment string"
EDGE_COLUMNS = "child_model string, child_column string, parent_model string, parent_column string, transformation_type string, ordinal int"
