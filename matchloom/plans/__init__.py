"""Query registry: importing this package registers every query."""

import importlib

MODULES = ["cleaning", "resumes", "skills", "retrieval", "scoring", "fairness", "evaluation", "jobs", "ingest", "streams"]

for _m in MODULES:
    importlib.import_module(f"matchloom.plans.{_m}")
