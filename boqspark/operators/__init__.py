"""boqspark.operators"""
