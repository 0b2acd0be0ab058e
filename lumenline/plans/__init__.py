"""Stage plans, documents and the registered queries."""
