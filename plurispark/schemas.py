"""The tables the operators work on, as DDL texts."""

UNIVERSES = "universe_id string, source_file string, decisions map<string,string>"
SPEC_INPUTS = "input_id string, source string"
SPEC_OUTPUTS = (
    "output_id string, type string, format string, command string, inputs array<string>, "
    "decisions array<string>, active boolean, resources map<string,string>"
)
TASKS = (
    "universe_id string, output_id string, output_path string, recipe string, format string, "
    "decisions map<string,string>, definition_version string, env_version string"
)
TASK_INPUTS = (
    "universe_id string, output_id string, input_name string, ord int, path string, "
    "produced_by string, current_version string"
)
TASK_EDGES = "universe_id string, output_id string, dep_output_id string"
MANIFESTS = (
    "schema_version int, output_id string, universe_id string, recipe string, definition_version string, "
    "env_version string, data_version string, decisions map<string,string>, input_versions map<string,string>, "
    "git_sha string, git_remote string, lc_version string, "
    "hermeticity struct<mechanism:string,fs:string,network:string,landlock_abi:int,exec_allowlist_version:int>, "
    "started_at string, finished_at string, uv_version string, "
    "image struct<tag:string,id:string,archive:string,arch:string>"
)
COMMITS = "seq bigint, sha string, subject string, author string, email string, date string"
COMMIT_PATHS = "seq bigint, path string"
STORAGE_KEYS = "path string, key string"
FILES = "path string, length bigint, content binary, modificationTime timestamp"
LOCK_PACKAGES = (
    "project_id string, name string, source map<string,string>, has_sdist boolean, n_wheels int"
)
RUN_LOGS = "task string, seq bigint, stream string, data binary"
POLICY_ROOTS = "policy_id string, tier string, root string"
PATH_FACTS = "path string, is_file boolean, executable boolean"
JOBS = (
    "job_id string, job_name string, uid string, state string, submit_time string, comment string"
)
OFFERS = (
    "position int, name string, provider string, cpus int, memory_bytes decimal(38,0), accel_name string, "
    "accel_count int, max_nodes int, default_s bigint, max_s bigint, idle_s bigint, startup string"
)
REQUESTS = (
    "request_id string, cpus int, min_cpus boolean, memory_bytes decimal(38,0), min_memory boolean, "
    "accel_name string, accel_count int, num_nodes int, seconds bigint, startup string"
)
WORKERS = "worker_id string, cpu double, memory double, gpu double"
TASK_EVENTS = "task string, ts timestamp, stream string, data binary, done boolean"
CHANGE_EVENTS = "path string, ts timestamp"
CITATIONS = "analysis_id string, doi string, version int"
