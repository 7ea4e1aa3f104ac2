"""Search: names, filters, joins, paging and folding of multi-valued cells."""
