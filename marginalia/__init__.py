"""marginalia: marginal-query analytics and private synthetic tables on Spark."""
