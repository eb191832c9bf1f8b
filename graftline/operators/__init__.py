"""graftline.operators"""
