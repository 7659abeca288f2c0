"""Column names of the standard transaction, customer and segment tables."""

CUSTOMER = "customer_id"
DATE = "transaction_date"
AMOUNT = "amount"

RECENCY = "recency"
FREQUENCY = "frequency"
MONETARY = "monetary"
RFM_METRICS = (RECENCY, FREQUENCY, MONETARY)
SCORES = ("R_score", "F_score", "M_score")

CLUSTER = "cluster"
LABEL = "Segment_label"
SEGMENT_COLUMNS = (CLUSTER, LABEL)

# An activity table holds these two measures in place of single amounts.
REVENUE = "revenue"
TRANSACTIONS = "transactions"
