"""Vocabulary of the property graph: node kinds, edge types, layers and limits (fixed values)."""

NODE_KINDS = (
    "file module namespace class interface function method property field variable enum service dotnet_project http_endpoint grpc_method "
    "external_api message_topic message_type database broker cache storage search ui_app ui_module ui_route ui_screen ui_frame ui_component "
    "ui_control ui_flow ui_style ui_surface"
).split()
EDGE_TYPES = (
    "imports exports calls inherits implements references contains injects depends_on project_reference http_calls exposes publishes consumes "
    "connects_to rpc_handles documents navigates_to binds_field invokes_api uses_style opens_flow binds_service"
).split()
CODE_KINDS = "file module namespace class interface function method property field variable enum".split()
PEER_KINDS = "service database broker external_api storage".split()
INSIDE_KINDS = "http_endpoint grpc_method dotnet_project message_topic message_type".split()
#: Edge types that never draw a node onto the root overview.
HIERARCHY_EDGES = "contains binds_service exposes invokes_api navigates_to uses_style opens_flow imports exports calls inherits implements references injects".split()
#: Edge types kept although an end is unknown: their target may come with a later batch.
OPEN_ENDED_EDGES = "http_calls exposes binds_service".split()
ANALYSED_STATUSES = "auto_found needed found".split()
READY_STATUSES = "success partial".split()
MAX_NODES, MAX_EDGES, MOST_NODES, MOST_EDGES = 200, 500, 1200, 4000
CASCADE_LIMIT, LANGUAGE_LIMIT, ID_BYTES = 5000, 50, 475
#: Languages by ending (fixed values), and three endings that this library adds.
EXTENSION_LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyw": "python", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp",
    "go": "go", "java": "java", "rb": "ruby", "rs": "rust", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell",
} | {"mts": "typescript", "cts": "typescript", "html": "html"}
#: Verbs and receivers of routes in TypeScript servers, and kinds of infrastructure by image name (fixed values).
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
ROUTE_RECEIVERS = ("app", "server", "fastify", "instance", "router")
INFRASTRUCTURE = (("database", "postgres|mysql|mariadb|mssql|mongo"), ("broker", "rabbit|kafka|redis"), ("storage", "minio|s3"))
#: Languages by interpreter (fixed values).
SHEBANG_LANGUAGES = {"python": "python", "python3": "python", "node": "javascript", "bash": "shell", "sh": "shell", "zsh": "shell"}
