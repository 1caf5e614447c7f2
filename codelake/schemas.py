"""Declared schemas of the relations."""

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"

NODE = (
    "node_id:string,parent_node_id:string,parent_kind:string,kind:string,subkind:string,language:string,"
    "name:string,display_name:string,qualified_path:string,"
    f"span:{SPAN},modifiers:array<string>,visibility:string,"
    "depth:int,inside_container:boolean,has_children:boolean,confidence:double"
)
IMPORT = f"kind:string,raw_text:string,target:string,alias:string,span:{SPAN}"
HINT = (
    "hint_no:int,source_path:string,kind:string,target_name:string,evidence:string,"
    f"span:{SPAN}"
)

PARSED_FIELDS = ["nodes", "imports", "hints"]

# One row per parsed file; the three relations are inlined from it on demand.
PARSED = (
    "root string, path string, file_id string, language string, "
    f"nodes array<struct<{NODE}>>, imports array<struct<{IMPORT}>>, "
    f"hints array<struct<{HINT}>>"
)

AUDIT = (
    "entryId string, requestId string, sessionId string, timestamp timestamp, "
    "operationType string, source string, operationName string, clientIp string, "
    "targetPath string, outcome string, errorCode string, description string, "
    "changeReason string, backupPath string, elapsedMs bigint, "
    "metadata map<string,string>"
)

SNAPSHOT_META = (
    "snapshot_id string, root string, created_at timestamp, mode string, "
    "file_count bigint, node_count bigint, symbol_count bigint, "
    "occurrence_count bigint, reference_count bigint, import_count bigint, "
    "diagnostic_count bigint, language_breakdown map<string,bigint>"
)
