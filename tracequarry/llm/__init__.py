"""Training-data operators: each module holds one operator, its query and, where SQL can say it, the query's SQL."""
