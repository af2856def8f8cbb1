"""The registered queries: input bindings, Spark plans and their SQL counterparts."""
