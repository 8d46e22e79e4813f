"""Fixed values of the memory model: names, weights and thresholds that results depend on."""

# Fixed values.
MEMORY_TYPES = ["fact", "preference", "goal", "project", "skill", "relationship", "event", "episodic", "pattern", "contact", "custom"]
SOURCE_TYPES = ["user_explicit", "agent_inference", "tool_output", "imported_file", "api"]
MEMORY_STATES = ["active", "warm", "cold", "archived"]
ENTITY_TYPES = ["project", "person", "company", "technology", "preference", "goal", "skill", "topic"]
FIELD_TYPES = ["string", "number", "boolean", "date", "enum", "array", "object"]
IMPORTANCE = {"fact": 0.45, "preference": 0.65, "goal": 0.75, "project": 0.8, "skill": 0.7, "relationship": 0.6, "event": 0.5, "episodic": 0.4, "pattern": 0.6, "contact": 0.7, "custom": 0.5}
CONFIDENCE = {"user_explicit": 1.0, "tool_output": 0.8, "agent_inference": 0.6, "imported_file": 0.7, "api": 0.7}
RETRIEVAL = {"semantic": 0.40, "graph": 0.25, "importance": 0.20, "recency": 0.10, "keyword": 0.05}
COLD_PENALTY, HALF_LIFE_DAYS = 0.3, 30.0
BUDGET = {"projects": 0.35, "goals": 0.20, "facts": 0.15, "episodic": 0.15, "preferences": 0.10, "relationships": 0.05}
CATEGORY = {"project": "projects", "goal": "goals", "preference": "preferences", "relationship": "relationships", "event": "episodic", "episodic": "episodic"}
SECTION = {"project": "active_projects", "preference": "preferences", "goal": "goals", "event": "recent_events", "episodic": "recent_events"}
ENTITY_OF_TYPE = {"project": "project", "preference": "preference", "goal": "goal", "skill": "skill", "relationship": "person"}
TECHNOLOGY_WORDS, COMPANY_WORDS = ["python", "redis", "postgres", "fastapi"], ["inc", "llc", "corp", "company"]
DECAY_DAYS = {"active": (30, "warm"), "warm": (90, "cold"), "cold": (180, "archived")}
DUPLICATE_ABOVE, MERGE_FROM, ENTITY_ABOVE, CONTRADICTION_FROM = 0.95, 0.85, 0.80, 0.80
LOW_VALUE = [
    r"^\s*(hi|hello|hey|yo|sup|thanks|thank you|ok|okay|cool)\s*[!.]*\s*$",
    r"^\s*(how are you|good morning|good afternoon|good evening)\s*[?.!]*\s*$",
    r"^\s*(lol|haha|nice|great|awesome|sounds good)\s*[!.]*\s*$",
]
POLICIES = {
    "coding-agent": (["project", "fact", "preference", "skill", "goal", "pattern"], [r"^\s*(thanks|ok|cool)\s*$"], {"project": 0.9, "skill": 0.75}),
    "crm-agent": (["contact", "relationship", "preference", "event", "fact"], [r"^\s*(hello|hi|thanks)\s*$"], {"contact": 0.9, "relationship": 0.8}),
    "tutor-agent": (["skill", "goal", "preference", "pattern", "fact"], [r"^\s*(yes|no|ok|thanks)\s*$"], {"goal": 0.85, "skill": 0.8}),
}
RATE_TIERS = {"hobby": (10, 20), "solo_pro": (50, 100), "team": (250, 500), "scale": (1000, 2000)}
STATUS_MOVES = {"active": ["inactive"], "inactive": ["active", "archived"], "archived": []}
MAX_PAYLOAD_BYTES, REQUIRED_FIELDS = 1 << 20, ["user_id", "organization_id", "session_id", "messages"]
METER_EVENTS = ["observation:created", "observation:batch", "memory:pin", "memory:unpin", "memory:archive", "memory:restore", "memory:delete"]
MAX_BATCH = 100
# End of fixed values.
