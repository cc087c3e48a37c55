"""DataFrame operators: crosswalks, lookups, joins, lists, numbering, changes, reports."""
