"""The registered queries: importing this package registers them all."""

from ferryline.plans import assessment, basics, functions, inventory, migration, tracking, workload, writes  # noqa: F401
