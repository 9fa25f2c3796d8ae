"""factloom: logical and relational learning on Spark tables.

Facts and rules become tables, tables become role-labelled graphs, graphs become hashed kernel features,
and features train and evaluate models; everything up to the features is a DataFrame plan.
"""
