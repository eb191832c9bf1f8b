"""graftline.plans"""
