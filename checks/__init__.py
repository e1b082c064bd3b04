"""SQL counterparts of the registered queries and the comparison that uses them."""
