"""Word lists and weights that queries must agree on."""

# Words that are no anchors, in stored text and in queries.
STOP = """
der die das und oder ist im in den dem ein eine auf mit fuer von zu the a an of to
in on for and or is with neue was wie ich soll nicht mehr aus als am bei nach vor wird
wurde this that these those it its as at by be are were has have had not no yes can will
would should owner claude code gates tests build test lint tsc commit feat fix docs
refactor chore merge branch
""".split()
# Words that queries leave out besides.
QUERY_STOP = """
what where when which whose does been being have having still then than
them they there here about into some just very much many such also
warum wieso weshalb wann welche welcher welches macht machen gemacht
haben hatte kann koennen muss muessen sollte sollten immer noch schon
dann denn auch gibt geht alle jetzt heute
""".split()
# Tags and what they are written as.
TAG_ALIASES = {
    "sec": "security", "auth": "security", "rls": "security", "xss": "security",
    "perf": "performance", "speed": "performance", "latency": "performance",
    "a11y": "accessibility", "i18n": "localization", "l10n": "localization",
    "db": "backend", "sql": "backend", "migration": "backend", "api": "backend",
    "css": "ui", "style": "ui", "layout": "ui", "design": "ui", "component": "ui",
    "bug": "bugfix", "hotfix": "bugfix", "patch": "bugfix",
    "feat": "feature", "feature": "feature",
    "doc": "docs", "documentation": "docs",
    "plans": "plan", "spec": "plan", "design-doc": "plan",
    "roadmaps": "roadmap", "milestone": "roadmap",
    "sprints": "sprint", "iteration": "sprint",
    "tasks": "task", "todo": "task", "todos": "task", "ticket": "task",
}
TAGS = [
    "security", "performance", "accessibility", "localization",
    "backend", "frontend", "ui", "bugfix", "feature", "docs",
    "logic", "math", "infra", "test", "new-code", "foundation",
    "chore", "plan", "roadmap", "sprint", "task",
    "open", "done", "dropped", "deferred",
]
# Weights of facets; all others weigh 1.
FACET_WEIGHTS = {
    "security": 2.0, "plan": 1.6, "logic": 1.5, "math": 1.5, "roadmap": 1.4, "sprint": 1.4,
    "bugfix": 1.3, "backend": 1.2, "frontend": 1.0, "task": 1.0, "ui": 0.8, "docs": 0.7, "chore": 0.3,
}
