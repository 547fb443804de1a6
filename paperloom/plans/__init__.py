"""Multi-operator plans: traffic, invoices, evaluation."""
