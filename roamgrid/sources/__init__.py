"""Where documents, tables and requests come from and go to."""
