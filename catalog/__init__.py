"""The registered queries, their inputs and the SQL they are compared with."""
