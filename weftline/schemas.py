"""Schemas of the tables that the operators read and write."""

NODES = "id string, workspace string, label string, kind string, file_path string, language string, line_start int, line_end int, text string, embedding array<float>, community int, file_hash string, created_at timestamp, updated_at timestamp"
EDGES = "id string, workspace string, source string, target string, type string, category string, metadata string, created_at timestamp"
EXTRACTED_EDGES = "workspace string, source_id string, target_label string, target_id string, edge_type string, category string"
PARSED_NODES = "id string, workspace string, label string, kind string, file_path string, language string, line_start int, line_end int, text string"
SOURCE_FILES = "workspace string, file_path string, content string, byte_size long, file_hash string"
STEP = "step_index int, source string, type string, status string, created_at timestamp, content string, thinking string, tool_calls array<struct<name:string,args:string>>, is_truncated boolean"
WORKSPACE_META = "workspace string, root_path string, is_worktree boolean, parent_workspace string, branch string, worktree_name string, updated_at timestamp"
FILE_EVENTS = "workspace string, seq long, ts timestamp, kind string, path string, new_path string"
DELTA_EVENTS = "workspace string, file_path string, kind string, old_path string"
